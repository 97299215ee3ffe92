"""Settings of a full audit and the venue presets."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Names looked for, in this order, in a folder and up to PARENTS of its parents; any other path can be given.
FILE_NAMES = ["config.yaml", "paperloom.yaml", "paperloom.yml", ".paperloom.yaml", ".paperloom.yml"]
PARENTS = 4
# Checkers in the order they run.
CHECKERS = ["caption", "reference", "formatting", "equation", "ai_artifacts", "sentence", "consistency", "acronym", "number", "citation_quality", "anonymization"]
# Id, name, field, page limits for review and final version, mandatory and encouraged sections, style package.
VENUES = [
    ("acl", "ACL 2025", "Natural Language Processing", 8, 9, ["Limitations"], ["Ethical Considerations"], "acl2025"),
    ("emnlp", "EMNLP 2024", "Natural Language Processing", 8, 9, ["Limitations"], ["Ethics Statement"], "emnlp2024"),
    ("naacl", "NAACL 2025", "Natural Language Processing", 8, 9, ["Limitations"], ["Ethics Statement"], "naacl2025"),
    ("cvpr", "CVPR 2025", "Computer Vision", 8, 8, [], [], "cvpr"),
    ("iccv", "ICCV 2025", "Computer Vision", 8, 8, [], [], "iccv"),
    ("eccv", "ECCV 2024", "Computer Vision", 14, 14, [], [], "eccv"),
    ("neurips", "NeurIPS 2025", "Machine Learning", 9, 10, ["Paper Checklist"], ["Broader Impact"], "neurips_2025"),
    ("icml", "ICML 2025", "Machine Learning", 8, 9, ["Impact Statement"], ["Acknowledgments"], "icml2025"),
    ("iclr", "ICLR 2025", "Machine Learning", 10, 10, [], ["Ethics Statement", "Reproducibility Statement"], "iclr2025_conference"),
]


def venues(spark: SparkSession, field_: str | None = None) -> DataFrame:
    """Venue presets, all double-blind, table captions above and figure captions below."""
    schema = "venue string, name string, field string, page_limit_review int, page_limit_camera int, mandatory_sections array<string>, optional_sections array<string>, style_package string"
    return spark.createDataFrame([v for v in VENUES if field_ in (None, v[2])], schema)


@dataclass
class Settings:
    """What a run reads, which checks it makes and where it writes; paths are absolute or relative to ``base``."""

    bib: str = ""
    tex: str = ""
    input_dir: str = ""
    output_dir: str = "paperloom_output"
    template: str = ""
    check_metadata: bool = True
    check_usage: bool = True
    check_duplicates: bool = True
    check_preprint_ratio: bool = True
    preprint_warning_threshold: float = 0.5
    check_relevance: bool = False
    checkers: list[str] = field(default_factory=lambda: list(CHECKERS))
    workflow: list[str] = field(default_factory=list)
    minimal_verified: bool = False
    base: str = "."

    def __post_init__(self):
        if self.template and self.template not in {v[0] for v in VENUES}:
            raise ValueError(f"unknown venue: {self.template}")

    def path(self, value: str) -> str:
        return value if not value or "://" in value else str(Path(self.base, value))


def settings_of(doc: dict | None, base: str = ".") -> Settings:
    """Settings from a parsed document: sections files, bibliography, submission, workflow, output; absent keys keep defaults."""
    doc = doc or {}
    known = {f.name for f in fields(Settings)} - {"base", "checkers", "workflow", "template"}
    values = {k: v for part in ("files", "bibliography", "output") for k, v in (doc.get(part) or {}).items() if k in known and v is not None}
    submission = doc.get("submission") or {}
    steps = [s["name"] for s in doc.get("workflow") or [] if s.get("enabled", True)]
    return Settings(**values, template=doc.get("template") or "", checkers=[c for c in CHECKERS if submission.get(c, True)], workflow=steps, base=base)


def load_settings(path: str) -> Settings:
    """Read a YAML file (JSON is YAML)."""
    import yaml

    return settings_of(yaml.safe_load(Path(path).read_text(encoding="utf-8")), str(Path(path).resolve().parent))


def find_settings(start: str = ".") -> str | None:
    """The first settings file in ``start`` or the nearest of its parents that has one."""
    at = Path(start).resolve()
    found = (folder / name for folder in [at, *at.parents][: PARENTS + 1] for name in FILE_NAMES)
    return next((str(f) for f in found if f.is_file()), None)

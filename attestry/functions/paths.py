"""What a path says by itself: licence-file names and weights, exclusions, prose, manifest and source files. Pure columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name patterns of licence files and their weights; the highest that matches counts.
_L, _C, _T, _X = "(un)?licen[sc]e", "copy(ing|right)", r"\.(md|markdown|txt|html)", r"\.[^./]+"
NAME_WEIGHTS = (
    (rf"^{_L}\z", 1.00),
    (rf"^{_L}{_T}\z", 0.95),
    (rf"^{_C}\z", 0.90),
    (rf"^{_C}{_T}\z", 0.85),
    (rf"^{_L}{_X}\z", 0.80),
    (rf"^{_C}{_X}\z", 0.75),
    (rf"^{_L}[-_][^.]*({_X})?\z", 0.70),
    (rf"^{_C}[-_][^.]*({_X})?\z", 0.65),
    (rf"^\w+[-_]{_L}[^.]*({_X})?\z", 0.60),
    (rf"^\w+[-_]{_C}[^.]*({_X})?\z", 0.55),
    (rf"^ofl{_T}\z", 0.50),
    (rf"^ofl{_X}\z", 0.45),
    (r"^ofl\z", 0.40),
    (r"^patents\z", 0.35),
    (rf"^patents{_X}\z", 0.30),
)
ROOT_BONUS, PROJECT_DEPTH = 0.5, 2
# Extensions that make a licence-named file something else, matched with their case.
IGNORED_EXTENSIONS = (".xml", ".go", ".gemspec", ".spdx", ".header")
# Directory and file names that exclude a path.
VENDORED = ("vendor", "third_party", "third-party", "thirdparty", "3rdparty", "external", "deps", "node_modules", "venv", ".virtualenv", "env", "rust-src", "rustc-src")
BUILD_OUTPUT = ("melange-out",)
TEST_FIXTURE = (
    "test", "tests", "testdata", "test_data", "test-data", "__tests__", "example", "examples", "fixture", "fixtures", "sample", "samples",
    "demo", "demos", "spec", "specs", "benchmark", "benchmarks",
)
SUPPLEMENTARY = ("patents", "patent", "notice", "notices", "authors", "contributors", "credits")
# Extensions of source files that may carry a notice.
NOTICE_EXTENSIONS = (
    ".c", ".h", ".cc", ".cpp", ".cxx", ".hpp", ".hh", ".go", ".rs", ".py", ".rb", ".pl", ".pm", ".sh", ".java", ".js", ".ts", ".cs", ".kt", ".swift",
    ".m", ".mm", ".lua", ".php", ".el", ".scm", ".ac", ".am", ".cmake", ".s", ".asm",
)
# Manifests by exact name, parent POMs by number.
MANIFESTS = ("package.json", "Cargo.toml", "pyproject.toml", "setup.cfg", "pom.xml", "go.mod", "METADATA", "PKG-INFO")
PROSE = r"(?iu)^(readme|copyright|copying|notice|authors)(\.[a-z0-9]+)?\z"
LICENSE_MENTION = r"(?iu)licen[sc]e"


def normalize_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def base_name(path: Column) -> Column:
    return F.substring_index(normalize_path(path), "/", -1)


def directory(path: Column) -> Column:
    """The path without its last segment; `.` at the top."""
    p = normalize_path(path)
    return F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, r"/[^/]*\z", "")).otherwise(F.lit("."))


def depth(path: Column) -> Column:
    """How many directories a path lies under."""
    return F.size(F.split(normalize_path(path), "/")) - 1


def terms_weight(path: Column) -> Column:
    """The weight of a licence file's name, null for other files. Only the name counts, not the place."""
    name = base_name(path)
    extension = F.regexp_extract(name, r"\.[^.]*\z", 0)
    weights = [F.when(name.rlike("(?iu)" + pattern), F.lit(weight)) for pattern, weight in NAME_WEIGHTS]
    return F.when(~extension.isin(*IGNORED_EXTENSIONS), F.coalesce(*weights))


def is_terms_file(path: Column) -> Column:
    return terms_weight(path).isNotNull()


def _segments(path: Column) -> Column:
    return F.transform(F.split(normalize_path(path), "/"), lambda s: F.regexp_replace(F.lower(s), r"-\d+\.\d+\.\d+-", "-"))


def dir_exclusion(path: Column) -> Column:
    """'' or why the place of a path excludes it. The first vendored or build-output segment decides; test fixtures come after."""
    segments = _segments(path)
    hit = F.get(F.filter(segments, lambda s: s.isin(*VENDORED, *BUILD_OUTPUT)), F.lit(0))
    return F.when(hit.isin(*VENDORED), "vendored").when(hit.isNotNull(), "build-output").when(F.exists(segments, lambda s: s.isin(*TEST_FIXTURE)), "test-fixture").otherwise("")


def is_supplementary(path: Column) -> Column:
    return F.lower(F.regexp_replace(base_name(path), r"\.[^.]*\z", "")).isin(*SUPPLEMENTARY)


def exclusion(path: Column) -> Column:
    """'' or the reason. A supplementary name beats a test fixture, and yields to vendored and build output."""
    place = dir_exclusion(path)
    return F.when(place.isin("vendored", "build-output"), place).when(is_supplementary(path), "supplementary").otherwise(place)


def is_prose_file(path: Column) -> Column:
    return base_name(path).rlike(PROSE)


def is_manifest_file(path: Column) -> Column:
    name = base_name(path)
    return name.isin(*MANIFESTS) | name.rlike(r"^pom-parent-[1-7]\.xml\z")


def is_notice_source(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.[^.]*\z", 0)).isin(*NOTICE_EXTENSIONS)


def retained(path: Column) -> Column:
    """What is kept of an archive: licence files, manifests, prose."""
    return is_terms_file(path) | is_manifest_file(path) | is_prose_file(path)


def outside_project(path: Column) -> Column:
    """Beyond the project scope: too deep, or under a vendored or build-output directory."""
    return (depth(path) > PROJECT_DEPTH) | ((depth(path) > 0) & dir_exclusion(directory(path)).isin("vendored", "build-output"))


def belongs_to_another(excluded: Column) -> Column:
    """Excluded for lying in someone else's tree; a supplementary file is still the component's own."""
    return excluded.isin("vendored", "build-output", "test-fixture")


def ancestors(path: Column) -> Column:
    """Every directory above a path, nearest last: the equi-join keys that replace prefix tests."""
    parts = F.split(normalize_path(path), "/")
    return F.transform(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def sanitize_member(raw: Column) -> Column:
    """An archive member's clean path, null if it is absolute or climbs out."""
    p = normalize_path(raw)
    parts = F.filter(F.split(p, "/"), lambda s: ~s.isin("", "."))
    climbs = F.exists(parts, lambda s: s == "..")
    return F.when(~p.startswith("/") & ~climbs & ~p.rlike(r"^[A-Za-z]:") & (F.size(parts) > 0), F.array_join(parts, "/"))

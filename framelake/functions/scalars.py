"""Column functions of names, paths, times and indices."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File endings that readers open (fixed values).
EXTENSIONS = (".h5", ".hdf5", ".nxs", ".tif", ".tiff", ".png", ".jpg", ".jpeg", ".vtk")
#: Endings of images that make a sequence.
IMAGES = (".tif", ".tiff", ".png", ".jpg", ".jpeg")
#: prefix_NNNTTTT_a_b_NUMBER.tif (the step is TTTT), and titles of seconds.
TIMESTEP = r"(?i)^[^_]+_\d{3}(\d{4})_[^_]+_[^_]+_(\d+)\.(tif|tiff)$"
TIME_TITLE = r"^t\s*=\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*s$"


def parse_timestep(name: Column) -> Column:
    """Time step (int) of a file name, null for other names."""
    got = F.regexp_extract(name, TIMESTEP, 1)
    return F.when(got != "", got.cast("int"))


def parse_time_title(title: Column) -> Column:
    """Seconds of a title such as 't = 0.45 s', null for other titles."""
    got = F.regexp_extract(F.trim(title), TIME_TITLE, 1)
    return F.when(got != "", got.try_cast("double"))


def sequence_pattern(name: Column) -> Column:
    """A glob of the name with its last number as *; characters that a glob reads otherwise stand in brackets."""
    parts = F.regexp_extract_all(name, F.lit(r"^(.*?)\d+\D*$"), F.lit(1))
    return F.when(F.size(parts) == 0, glob_escape(name)).otherwise(F.concat(
        glob_escape(F.regexp_replace(name, r"\d+\D*$", "")), F.lit("*"), glob_escape(F.regexp_extract(name, r"\d(\D*)$", 1)),
    ))


def glob_escape(name: Column) -> Column:
    return F.regexp_replace(name, r"([*?\[])", "[$1]")


def sequence_number(name: Column) -> Column:
    return F.regexp_extract(name, r"(\d+)\D*$", 1).try_cast("long")


def glob_match(name: Column, pattern: str) -> Column:
    """Shell pattern (*, ?, [...]) on whole names; letters' case counts."""
    regex = fnmatch.translate(pattern).replace(r"\Z", "").replace(r"\z", "").replace("(?s:", "(?s)(?:")
    return name.rlike(f"^{regex}$")


def normalise_path(path: Column) -> Column:
    """Path with / between parts and no empty or . parts; null where a part is .. ."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    return F.when(~F.exists(parts, lambda p: p == ".."), F.array_join(parts, "/"))


def relative_path(path: Column, base: Column) -> Column:
    """Path from base if it lies inside, else unchanged."""
    inside = F.startswith(path, F.concat(base, F.lit("/")))
    return F.when(path == base, F.lit(".")).when(inside, F.substr(path, F.length(base) + 2)).otherwise(path)


def extension(name: Column) -> Column:
    """Lower-case ending with its dot, '' without one; a leading dot is part of the name."""
    return F.lower(F.regexp_extract(name, r"[^./](\.[^./]+)$", 1))


def openable(name: Column) -> Column:
    return extension(name).isin(*EXTENSIONS)


def image(name: Column) -> Column:
    return extension(name).isin(*IMAGES)


def natural_key(name: Column) -> Column:
    """array<string> that sorts as text (folded) and numbers in turn; it starts with text, maybe empty."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda p: F.regexp_replace(p, "^0+", "")
    number = lambda p: F.concat(F.lpad(F.length(digits(p)).cast("string"), 10, "0"), digits(p))  # noqa: E731  longer ones are greater
    keyed = F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), number(p)).otherwise(p))
    return F.when(name.rlike(r"^\d"), F.concat(F.array(F.lit("")), keyed)).otherwise(keyed)


def reflect_index(i: Column, n: Column | int) -> Column:
    """Half-sample mirror of an index at both ends of 0 .. n-1, any number of times."""
    n = F.lit(n) if isinstance(n, int) else n
    j = F.pmod(i, 2 * n)
    return F.when(j < n, j).otherwise(2 * n - 1 - j)


def json_metadata(metadata: Column) -> Column:
    """JSON of a struct or map; non-finite numbers of a map<string,double> are null."""
    return F.to_json(metadata, {"ignoreNullFields": "false"})


def finite(value: Column) -> Column:
    """The value, null if it is NaN or infinite."""
    return F.when(F.isnan(value) | value.isin(float("inf"), float("-inf")), F.lit(None)).otherwise(value)

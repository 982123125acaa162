"""Name and key normalisation; every rule is one JVM-side expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def given(c: Column) -> Column:
    """Neither null nor blank."""
    return c.isNotNull() & (F.trim(F.regexp_replace(c, r"\s+", " ")) != "")


def entity_key(c: Column) -> Column:
    """Upper case, A-Z and 0-9 only, leading zeros of the final number dropped."""
    kept = F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    return F.regexp_replace(kept, "(^|[^0-9])0+([0-9]+)$", "$1$2")


def label_key(c: Column) -> Column:
    """The lenient rule: underscore and hyphen removed, upper case."""
    return F.upper(F.regexp_replace(c, "[_-]", ""))


def strict_key(c: Column) -> Column:
    """The strict rule: A-Z and 0-9 only."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


#: DuckDB spelling of the two rules above, for oracle queries.
def entity_key_sql(c: str) -> str:
    return rf"regexp_replace(regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g'), '(^|[^0-9])0+([0-9]+)$', '\1\2')"


def given_sql(c: str) -> str:
    return rf"({c} is not null and trim(regexp_replace({c}, '\s+', ' ', 'g')) <> '')"


def canonical_label(label: Column, patient: Column) -> Column:
    """Patient prefix, trailing polarity and separators dropped, upper case."""
    t = F.upper(F.trim(label))
    p = F.regexp_replace(F.upper(patient), "[^A-Z0-9]", "")
    bare = F.regexp_replace(t, "[^A-Z0-9+-]", "")
    bare = F.when(F.startswith(bare, p), F.substring(bare, F.length(p) + 1, F.length(bare))).otherwise(bare)
    return F.regexp_replace(F.regexp_replace(bare, "[+-]+$", ""), "[^A-Z0-9]", "")


def shaft(label: Column) -> Column:
    """What stands before the final number of a normalised label."""
    return F.regexp_extract(label, r"^(.*?)\d*$", 1)


def contact_number(label: Column) -> Column:
    """The final number of a normalised label, null without one."""
    return F.nullif(F.regexp_extract(label, r"(\d{1,9})$", 1), F.lit("")).cast("int")


def canonical_condition(c: Column, table: dict[str, str], prefixes: dict[str, str]) -> Column:
    """By the table, else by the first prefix that fits, else unchanged."""
    t = F.lower(F.trim(c))
    out = c
    for p, name in reversed(list(prefixes.items())):
        out = F.when(F.startswith(t, F.lit(p)), F.lit(name)).otherwise(out)
    for given_, name in table.items():
        out = F.when(t == given_, F.lit(name)).otherwise(out)
    return out


def centre(patient: Column) -> Column:
    """Centre by the patient's prefix."""
    p = F.upper(F.trim(patient))
    return F.when(p.startswith("EL"), "EL").when(p.startswith("PAT"), "PAT").when(p.startswith("MICRO"), "MICRO").otherwise("OTHER")


#: Names of channels that record no neural tissue.
NON_NEURAL = r"PHOTO|MRK|ECG|EKG|EMG|EOG|AUDIO|AINP|^[XE][1-8]$|\+|SCALP|TRIG|REF|GROUND"


def non_neural(label: Column) -> Column:
    """Whether a channel's name says it records no neural tissue."""
    return F.coalesce(F.upper(label).rlike(NON_NEURAL), F.lit(False))

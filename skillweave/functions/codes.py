"""Expressions on classification codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MAJOR_GROUPS = {
    "1": "Managers",
    "2": "Professionals",
    "3": "Technicians and Trades Workers",
    "4": "Community and Personal Service Workers",
    "5": "Clerical and Administrative Workers",
    "6": "Sales Workers",
    "7": "Machinery Operators and Drivers",
    "8": "Labourers",
}
LEVEL_LABELS = {
    "Certificate I": "Foundation",
    "Certificate II": "Entry Level",
    "Certificate III": "Trades / Operational",
    "Certificate IV": "Advanced Trades / Paraprofessional",
    "Diploma": "Paraprofessional / Technician",
    "Advanced Diploma": "Advanced Technician / Associate Professional",
    "Graduate Certificate": "Postgraduate Specialist",
    "Graduate Diploma": "Graduate Specialist",
    "Bachelor Degree": "Professional",
    "Honours Degree": "Honours Professional",
    "Masters Degree": "Expert / Researcher",
    "Doctoral Degree": "Research Expert",
}
OCCUPATION_URI = "https://www.abs.gov.au/anzsco/"


def major_group(code: Column) -> Column:
    """Title of the major group of an occupation code, else ''."""
    table = F.create_map(*[F.lit(x) for kv in MAJOR_GROUPS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.substring(code, 1, 1)), F.lit(""))


def occupation_uri(code: Column) -> Column:
    return F.when(F.coalesce(code, F.lit("")) == "", "").otherwise(F.concat(F.lit(OCCUPATION_URI), F.regexp_replace(code, "[ -]", "")))


def level_label(level: Column, longest: bool = False) -> Column:
    """Label of a qualification level by the first name that it contains, in the order of the table.

    With `longest` the longest name counts, so that 'Certificate III' is not taken for 'Certificate I'.
    """
    names = sorted(LEVEL_LABELS, key=lambda n: -len(n)) if longest else list(LEVEL_LABELS)
    out = F.when(F.coalesce(level, F.lit("")) == "", "Unspecified")
    for name in names:
        out = out.when(F.contains(F.lower(level), F.lit(name.lower())), LEVEL_LABELS[name])
    return out.otherwise(level)


def level_rank(level: Column) -> Column:
    """1 for the lowest known level; null for unknown ones."""
    out = None
    for i, name in enumerate(LEVEL_LABELS, 1):
        out = F.when(level == name, i) if out is None else out.when(level == name, i)
    return out


def owner(unit_code: Column, package: Column | None = None) -> Column:
    """The package that owns a unit: as stated, else the code's first three characters."""
    prefix = F.substring(unit_code, 1, 3)
    return prefix if package is None else F.coalesce(F.nullif(F.trim(package), F.lit("")), prefix)


def imported(unit_code: Column, package: Column) -> Column:
    return ~F.startswith(unit_code, F.substring(package, 1, 3))


def element_id(unit_code: Column, ordinal: Column) -> Column:
    return F.format_string("%s-E%02d", unit_code, ordinal)


def effective_code(code: Column, value: Column) -> Column:
    """The code if it holds something, else the value; trimmed."""
    return F.trim(F.coalesce(F.nullif(F.trim(code), F.lit("")), F.nullif(F.trim(value), F.lit("")), F.lit("")))


def evidence(statement: Column, given: Column) -> Column:
    """Evidence stub: a given hash counts as verified, else the statement's own hash stands in."""
    stand_in = F.concat(F.lit("sha256:"), F.sha2(F.coalesce(statement, F.lit("")), 256))
    has = F.coalesce(given, F.lit("")) != ""
    return F.struct(F.when(has, given).otherwise(stand_in).alias("hash"), has.alias("verified"), (~has).alias("placeholder"))

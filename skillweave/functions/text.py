"""Text expressions: rule checks, classifiers and normalisers. All are built-in columns, no Python runs per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: word lists that decide results -----------------------------------------------------------------
METHOD_HINTS = r"(?i)\busing\b|\bby\b|\bthrough\b|\bapplying\b|\bfollowing\b|\butilising\b|\bemploying\b|\bvia\b"
OUTCOME_HINTS = r"(?i)\bto\b|\benabling\b|\bensuring\b|\bso that\b|\bresulting in\b|\bproducing\b|\bachieving\b|\bdemonstrat\b|\bdeliver\b"
FEWEST_WORDS, MOST_WORDS = 30, 60
ACTION_VERBS = (
    "analyse apply assess calculate check clean collect communicate complete conduct confirm control coordinate create define demonstrate "
    "design develop document ensure establish evaluate identify implement inspect install interpret maintain manage measure monitor operate "
    "perform plan prepare process record report review select test use verify"
).split()
DOMAINS = {
    "Lab/Science": "lab laboratory chemical sample calibrat instrument test measure analys specim reagent equipment",
    "Business": "communicat report document stakeholder client customer manage plan organis budget financ strateg",
    "Mining/RII": "mine drill blast excavat ore shaft tunnel ground site hazard ppe safety",
    "IT/Digital": "software system network data digital code program database cyber cloud api",
    "Health/Care": "patient care health clinical medication treatment wound assess monitor symptom",
    "Construction": "build construct install weld concrete structural scaffold blueprint material site",
    "Agriculture": "crop livestock soil farm irrigation harvest pest plant animal paddock",
}
VERB_GROUPS = {
    "Analyse": "analyse assess evaluate review inspect examine monitor measure test verify check",
    "Apply": "apply use operate implement execute perform conduct complete carry undertake",
    "Communicate": "communicate report document record prepare present liaise coordinate consult advise notify",
    "Develop": "develop design create establish build construct plan prepare produce generate",
    "Manage": "manage control maintain supervise lead direct ensure comply adhere follow",
    "Identify": "identify determine select choose classify categorise prioritise locate detect recognise",
}
COMPLEXITY = {
    9: "complex advanced critical strategic expert specialist evaluate design develop analyse assess",
    5: "apply implement monitor review coordinate manage maintain conduct prepare",
    2: "follow complete record report assist support check clean collect provide",
}
UNIT_CODE = r"^[A-Z]{2,8}\d{3,6}[A-Z]?$"
ELEMENT_LINE = r"^(\d+)\.?\s+(?![\d.])(.*)"
CRITERION_LINE = r"^(\d+\.\d+)\.?\s+(.*)"
STOP_WORDS = (
    "a about above after again against all also am an and any are as at be because been before being below between both but by can cannot "
    "could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in "
    "into is it its itself me more most my myself no nor not of off on once only or other our ours ourselves out over own same she should so "
    "some such than that the their theirs them themselves then there these they this those through to too under until up very was we were "
    "what when where which while who whom why will with would you your yours yourself yourselves"
).split()
# --- end of fixed values ------------------------------------------------------------------------------------------

WORD = r"[\p{L}\p{N}_]+"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def has_text(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def one_sentence(text: Column) -> Column:
    """No sentence break inside the stripped text."""
    return F.size(F.regexp_extract_all(stripped(text), F.lit(r"[.!?]\s+"), F.lit(0))) == 0


def qa(text: Column) -> dict[str, Column]:
    """The rule check of a statement, by flag name."""
    one, n = one_sentence(text), word_count(text)
    method, outcome = text.rlike(METHOD_HINTS), text.rlike(OUTCOME_HINTS)
    return {"one_sentence": one, "word_count": n, "has_method": method, "has_outcome": outcome, "passes": one & n.between(FEWEST_WORDS, MOST_WORDS) & method & outcome}


def qa_issues(text: Column) -> Column:
    """What a failing statement needs, one sentence per issue; '' for none. The sentences are fixed values."""
    flags = qa(text)
    n = flags["word_count"]
    return F.concat_ws(
        " ",
        F.when(~flags["one_sentence"], "The statement must be exactly one sentence."),
        F.when(n < FEWEST_WORDS, F.concat(F.lit("Too short ("), n.cast("string"), F.lit(" words). Aim for 30–60 words."))),
        F.when(n > MOST_WORDS, F.concat(F.lit("Too long ("), n.cast("string"), F.lit(" words). Shorten to 30–60 words."))),
        F.when(~flags["has_method"], "Add a method phrase (e.g. 'using …', 'by applying …', 'through …')."),
        F.when(~flags["has_outcome"], "Add an outcome phrase (e.g. 'to ensure …', 'enabling …', 'resulting in …')."),
    )


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def primary_verb(text: Column) -> Column:
    """The first action verb of a text, else 'other'."""
    return F.coalesce(F.try_element_at(F.filter(words(text), lambda w: w.isin(*ACTION_VERBS)), F.lit(1)), F.lit("other"))


def _once(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it (keeps the generated code small)."""
    return F.transform(F.array(value), body)[0]


def domain(text: Column) -> Column:
    """The domain with most keywords in the text (each counted once, also inside words); first of equals, else 'General'."""
    def ranked(low: Column) -> Column:
        hits = [F.struct(F.size(F.filter(_literals(ks.split()), lambda k: F.contains(low, k))).alias("n"), F.lit(-i).alias("first"), F.lit(d).alias("name")) for i, (d, ks) in enumerate(DOMAINS.items())]
        return F.array_max(F.array(*hits))

    return _once(_once(F.coalesce(F.lower(text), F.lit("")), ranked), lambda best: F.when(best["n"] == 0, "General").otherwise(best["name"]))


def verb_group(text: Column) -> Column:
    """The first verb group of which a word occurs, else 'Other'."""
    def chosen(found: Column) -> Column:
        hits = [F.struct(F.arrays_overlap(found, _literals(verbs.split())).alias("hit"), F.lit(group).alias("name")) for group, verbs in VERB_GROUPS.items()]
        return F.coalesce(F.try_element_at(F.filter(F.array(*hits), lambda h: h["hit"]), F.lit(1))["name"], F.lit("Other"))

    return _once(words(text), chosen)


def complexity(text: Column) -> Column:
    """Score from 1 to 10 by signal words, with a bonus for length; 5.0 without signals."""
    levels = list(COMPLEXITY)

    def counted(found: Column) -> Column:
        among = lambda signals: lambda w: w.isin(*signals.split())
        return F.struct(*[F.size(F.filter(found, among(COMPLEXITY[w]))).alias(f"n{w}") for w in levels], F.size(found).alias("words"))

    def scored(c: Column) -> Column:
        total = reduce(lambda a, b: a + b, [c[f"n{w}"] for w in levels])
        weighted = reduce(lambda a, b: a + b, [c[f"n{w}"] * w for w in levels])
        score = weighted / F.nullif(total, F.lit(0)) + F.least(c["words"] / F.lit(20.0), F.lit(1.5))
        return F.when(F.coalesce(total, F.lit(0)) <= 0, 5.0).otherwise(F.round(F.least(F.greatest(score, F.lit(1.0)), F.lit(10.0)), 1))

    return _once(_once(words(text), counted), scored)


def band(score: Column, high: float, middle: float, names: tuple[str, str, str] = ("High", "Medium", "Low")) -> Column:
    return F.when(score >= high, names[0]).when(score >= middle, names[1]).otherwise(names[2])


def listed(text: Column, pattern: str) -> Column:
    """Parts between delimiters, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, pattern), lambda x: F.trim(x)), lambda x: x != "")


def tidy_taxonomy(text: Column) -> Column:
    """A packed taxonomy value as one ', '-joined text; '' and N/A pass through."""
    return F.when(text.isin("", "N/A"), text).otherwise(F.array_join(listed(text, r"[\n\r;|•]+"), ", "))


def routed(scheme: Column) -> Column:
    """The field that a classification scheme feeds."""
    has = lambda t: F.contains(scheme, F.lit(t))
    return F.when(has("ANZSCO"), "anzsco").when(has("Industry") | has("Sector"), "industry").when(has("Occupation") | has("Taxonomy"), "occupation")


def prompt(unit_code: Column, unit_title: Column, element: Column, criteria: Column) -> Column:
    """The request for one statement about an element."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.format_string("Unit code: %s\nUnit title: %s\nElement title: %s\nPerformance criteria:\n%s\n\nWrite one skill statement for this element.", blank(unit_code), blank(unit_title), blank(element), blank(criteria))


def content_terms(text: Column, ngrams: int = 1) -> Column:
    """Words of two or more characters without stop words; with ngrams=2 also pairs of neighbours among them."""
    # isin is a hash lookup; looking through an array of literals would compare with every one of them.
    single = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS))
    if ngrams == 1:
        return single
    pairs = F.when(F.size(single) > 1, F.transform(F.sequence(F.lit(1), F.size(single) - 1), lambda i: F.concat(F.element_at(single, i), F.lit(" "), F.element_at(single, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(single, pairs)

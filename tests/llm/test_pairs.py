import pytest

from skillweave.llm import pairs

PROMPT = "Unit ABC: Sort the deck hatch\nElement: Clean the bilge pump and hull plate\nCriteria\n1.1 Inspect the anchor winch before each shift\n1.2 Record the result in the logbook and notify affected people\n\nWrite one statement."
GOOD = [f"{v} the {n} by applying site procedures, using hand lenses, to build client trust and keep people safe." for v in ("Sort", "Clean", "Test", "Load", "Mix") for n in ("mast", "cleat", "fender", "galley")]
CASES = {
    None: "empty", "": "empty", " \n": "empty", "​": "empty", "N/A": "empty", "(no output)": "empty", "[empty]": "empty", '""': "empty", "...": "empty", "ERROR: request timed out": "empty", "HTTP 503": "empty",
    "I'm sorry, but I can’t write this.": "refusal", "Regrettably a statement will not be given.": "refusal", "As an AI language model I must decline to answer.": "refusal", "Sorry, an answer falls outside the things I may answer.": "refusal",
    PROMPT: "copy", PROMPT.upper(): "copy", "Element: Clean the bilge pump and hull plate": "copy", "Inspect the anchor winch before each shift. Record the result in the logbook and notify affected people.": "copy",
    "Limpiar los filtros y los tanques antes de cada turno, para mantener la calidad del producto.": "language", "清洗过滤器和水箱在多个工地。": "language", "Die Filter und die Tanks mit Sorgfalt reinigen, um den Ausschuss zu senken": "language",
    "Sort the mast by applying site procedures, using hand lenses, to build client tr": "truncated", "Sort the mast by applying site procedures, using hand": "truncated", "Sort the mast by applying site procedures, to build clie…": "truncated", "Sort the mast by applying and the": "truncated",
    "Sort the mast by applying site procedures, using hand lenses, to build client trust and keep people safe": None,
    "Sorry signage aside, repair the cleat by applying site procedures, to keep people safe.": None, "Refuse unsafe cleats so that a volunteer who cannot lift can keep people safe.": None,
    "Sort café-style the mast by applying site procedures!": None,
}


def run(spark, values):
    rows = [(i, p, r, "x", True, "y") for i, (p, r) in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, p string, r string, label string, qa_passes boolean, pair string").repartition(3)
    return {r.record_id: r.defect for r in pairs.broken_pairs(df, record_id="id", prompt="p", response="r").collect()}


def test_cases(spark):
    values = [(PROMPT, r) for r in CASES] + [(PROMPT, g) for g in GOOD]
    found = run(spark, values)
    assert {i: d for i, d in enumerate(CASES.values()) if d} == found


def test_null_and_blank_prompts(spark):
    assert run(spark, [(None, GOOD[0]), ("", GOOD[1]), (None, None)] + [(None, g) for g in GOOD]) == {2: "empty"}


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_long_and_repeated(spark):
    long = "lift the crate with care and " * 20_000
    values = [(PROMPT, long + "keep people safe.")] * 2 + [(long, long)] + [(PROMPT, g) for g in GOOD]
    assert run(spark, values) == {2: "copy"}


@pytest.mark.parametrize("text,final", [("a.", True), ("a...", False), ("a…", False), ('a."', True), ("a", False), ("a。", True), ("a?)", True)])
def test_final_marks(text, final):
    assert pairs.last_pair(text)[1] is final


@pytest.mark.parametrize(
    "text",
    [
        "Explain to clients that we do not release records without their consent, to uphold privacy obligations.",
        "Record the statement 'I cannot sleep' in the notes by applying site procedures, to keep people safe.",
        "Tell visitors: sorry, we cannot open the hatch, and repair the cleat by applying site procedures.",
        "Error: messages are recorded using the log by applying site procedures, to keep people safe.",
        "Well made cleats will not be given away; stack them by applying site procedures, to keep people safe.",
    ],
)
def test_declining_and_errors_inside_an_answer(text):
    assert not pairs.is_refusal(text) and not pairs.is_empty(text)


@pytest.mark.parametrize(
    "text",
    ["I can't do that.", "Hello! Unfortunately, I won't be able to help with this.", "We do not have enough information to answer.", "Sure, but I must decline.", "Thanks for asking. This request falls outside my task.", "Sorry - that is not something I can answer.", "This prompt cannot be answered."],
)
def test_declining(text):
    assert pairs.is_refusal(text)


@pytest.mark.parametrize("text", ["Rengør filtre og tanke før hver vagt, så det ikke skal gentages", "Puhdista säiliöt ja suodattimet ennen vuoroa", "Curățați filtrele și rezervoarele înainte de fiecare schimb", "Čistit filtry a nádrže před směnou podle pokynů", "Szűrők és tartályok tisztítása minden műszak előtt", "Safisha vichungi na matangi kabla ya kila zamu"])
def test_languages_by_dictionary(text):
    assert pairs.is_foreign(text)


def test_languages_without_a_dictionary(spark):
    foreign = [
        "Puhdistaa suodattimet ja säiliöt ennen jokaista työvuoroa laadun ylläpitämiseksi.",
        "Vyčistit filtry a nádrže před každou směnou, aby byla zachována kvalita výrobků.",
        "A szűrők és a tartályok tisztítása minden műszak előtt a minőség megőrzése érdekében.",
        "Curățarea filtrelor și rezervoarelor înainte de fiecare schimb pentru menținerea calității produselor.",
    ]
    terse = "Sort mast, clean cleat, test fender, load galley, build client trust, keep people safe."
    values = [(PROMPT, r) for r in [*foreign, terse]] + [(PROMPT, g) for g in GOOD]
    assert run(spark, values) == dict.fromkeys(range(len(foreign)), "language")

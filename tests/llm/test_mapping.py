import pytest

from skillweave.llm import mapping

LIST = [("1", "Harbour Recording Coordinator"), ("2", "Harbour Kilning Technician"), ("3", "Pastry Carving Technician"), ("4", "Pasture Carving Technician"), ("5", "Linen Finishing Surveyor"), ("6", "Sewer Laminating Analyst"), ("7", "Sewer Laminating Officer")]
CASES = {
    "HARBOUR RECORDING COORDINATOR": "1",
    "Harbour Recording Co-ordinator": "1",
    "Coordinator - Recording, Harbour": "1",
    "Harbör Recroding Coord.": "1",
    "Trainee Harbour Recording Coordinator - day shift": "1",
    "Harbour Coordinator, Quill Bay": "1",
    "HarbourRecording Coordinator": "1",
    "HarbourxRecording Coordinator": "1",
    "Pastry Carving Technicians": "3",
    "Past. Carving Tech": "",
    "Carving Technician": "",
    "Sewer Laminating": "",
    "Sewer Laminating Analsyt": "6",
    "Linen Surveyor": "5",
    "Linen Finishing Barber": "",
    "Meteorite Barber": "",
    "Surveyor": "",
    "see attached sheet": "",
}
NONE = [None, "", "  ", "-", "N/A", "n.a.", "none", "...", "NULL"]


@pytest.fixture(scope="module")
def find(spark):
    def run(values, entries=LIST):
        rows = spark.createDataFrame([(i, v, "x", "y") for i, v in enumerate(values)], "id long, v string, code string, value string")
        listed = spark.createDataFrame(entries, "c string, t string")
        return {r.row_id: r.code for r in mapping.map_values(rows, listed, row_id="id", value="v", code="c", title="t").collect()}

    return run


def test_cases(find):
    assert find(list(CASES)) == dict(enumerate(CASES.values()))


def test_no_value_has_no_row(find):
    assert find(NONE) == {}


def test_repeats_and_long_values(find):
    assert find(["Linen Finishing Surveyor"] * 50) == dict.fromkeys(range(50), "5")
    assert find(["word " * 20_000]) == {0: ""}


def test_hot_values(find, monkeypatch):
    monkeypatch.setattr(mapping, "HOT_ROWS", 10)
    values = ["Linen Finishing Surveyor"] * 50 + ["nothing alike"] * 50 + ["Sewer Laminating Analyst"] * 3
    assert find(values) == dict(enumerate(["5"] * 50 + [""] * 50 + ["6"] * 3))


def test_blocks_of_the_list(find, monkeypatch):
    monkeypatch.setattr(mapping, "LIST_BLOCK", 2)
    assert find(list(CASES)) == dict(enumerate(CASES.values()))


def test_empty(find):
    assert find([]) == {} and find(["Linen Surveyor"], []) == {0: ""}
    assert find(["Linen Surveyor"], [(None, "Linen Finishing Surveyor"), ("9", None)]) == {0: ""}


def test_ties_are_no_match(find):
    assert find(["Linen Finishing Surveyor"], [("5", "Linen Finishing Surveyor"), ("8", "Linen Finishing Surveyor")]) == {0: ""}


def test_blocks_share_weights_and_words(find, monkeypatch):
    """A word of another block isn't a misspelling, and titles of one code are no tie, wherever the list is cut."""
    listed = LIST + [("8", "Sailor Painting Officer"), ("9", "Tailor Mending Clerk"), ("10", "Copper Smelting Porter"), ("10", "Copper Smelting Porters")]
    values = ["Sailor Mending Clerk", "Tailor Mending Clerk", "Taylor Mending Clerk", "Copper Smelting Porter", "Copper Porter", *CASES]
    whole = find(values, listed)
    assert [whole[i] for i in range(5)] == ["", "9", "9", "10", "10"]
    for size in (1, 2, 4):
        monkeypatch.setattr(mapping, "LIST_BLOCK", size)
        assert find(values, listed) == whole

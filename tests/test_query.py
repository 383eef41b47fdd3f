"""Query grammar, evaluation, and golden retrieval over a seven-document corpus."""

import pytest

from skein.operators import index, retrieve
from skein.plans import query as Q

CORPUS = {
    1: "apple banana cherry date elder fig", 2: "banana cherry grape honey iris jade", 3: "apple cherry elder grape kiwi lemon",
    4: "cherry fig grape honey iris date", 5: "apple date banana fig grape honey", 6: "apple banana cherry fig elder grape", 7: "apple kiwi date grape honey iris",
}
GOLDEN = {
    "apple": {1, 3, 5, 6, 7}, "jade": {2}, "zzzzz": set(), "apple banana": {1, 5, 6}, "apple banana cherry": {1, 6}, "kiwi | jade": {2, 3, 7},
    "apple -banana": {3, 7}, "grape -(apple | iris)": set(), '"banana cherry"': {1, 2, 6}, '"cherry banana"': set(), '"grape honey"': {2, 4, 5, 7},
    '"grape honey iris"': {2, 4, 7}, 'apple "grape honey"': {5, 7}, '"banana cherry" -grape': {1}, '-"banana cherry" apple': {3, 5, 7},
    '"elder fig" | "kiwi lemon"': {1, 3}, "(apple | jade) (kiwi | iris)": {2, 3, 7}, "apple (banana | -date)": {1, 3, 5, 6}, '"apple" "apple"': {1, 3, 5, 6, 7},
}


@pytest.fixture(scope="module")
def postings(spark):
    rows = [(d, w, i + 1) for d, t in CORPUS.items() for i, w in enumerate(t.split())]
    return index.invert(spark.createDataFrame(rows, "doc_id long, term string, loc int")).cache()


@pytest.mark.parametrize("text", GOLDEN)
def test_golden(postings, text):
    assert {r.doc_id for r in retrieve.match(postings, text).collect()} == GOLDEN[text]


@pytest.mark.parametrize("text", ["(apple banana", "apple banana)", "apple |", "apple -", "apple -| banana", "apple () banana", "apple || banana", "-apple", "-(apple | banana)", "-apple -banana", "good | -bad"])
def test_refused(postings, text):
    with pytest.raises(Q.QueryParseError):
        Q.parse(text)
    assert retrieve.match(postings, text).count() == 0


@pytest.mark.parametrize(
    ("text", "words", "hit"),
    [
        ("apple banana", "apple banana", True), ("apple banana", "apple orange", False), ("cat | dog", "fish dog", True), ("cat | dog", "fish bird", False),
        ("movie -scary", "movie funny", True), ("movie -scary", "movie scary", False), ("(car | truck) (red | blue) -broken", "truck blue slow", True),
        ("(car | truck) (red | blue) -broken", "car red broken", False), ("recipe -(nuts | dairy)", "recipe chicken", True), ("recipe -(nuts | dairy)", "recipe dairy", False),
        ("--apple", "apple", True), ("sci-fi", "sci-fi", True),
    ],
)
def test_evaluation(text, words, hit):
    assert Q.matches(Q.parse(text), set(words.split())) is hit


def test_shape():
    assert Q.parse("") is None
    assert Q.tokenize('a "b c') == [("word", "a"), ("phrase", "b c")]
    assert [t.text for t in Q.leaves(Q.parse("a -(b c)"))] == ["a", "b", "c"]
    assert len(Q.branches(Q.parse("(a | b) (c | d)"))) == 4
    assert Q.positive_words(Q.parse('b "x y" -c a')) == ["b", "a", "x", "y"]
    with pytest.raises(Q.QueryParseError):
        Q.parse(" ".join(f"(a{i} | b{i})" for i in range(12)))


def test_empty_phrase(postings):
    assert retrieve.match(postings, '"" apple').count() == 0


def test_positions(postings):
    q = "apple | iris"
    rows = {r.doc_id: r.places for r in retrieve.positions(retrieve.match(postings, q), q).collect()}
    assert rows[7] == [[1], [6]] and rows[1] == [[1], []]
    assert {(r.doc_id, r.loc) for r in retrieve.phrase(postings, ["grape", "honey"]).collect()} == {(2, 3), (4, 3), (5, 5), (7, 4)}


def test_round_trip(postings):
    assert {r.doc_id: " ".join(r.words) for r in index.rebuild(postings).collect()} == CORPUS

"""Pure functions: cleaning, tokens, stems, queries, amounts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clausemill.kernels import annotate, clean, ocr, query, stem, tokens, words
from clausemill.kernels.query import Operand
from clausemill.plans import pipelines


def test_cleaning_steps():
    assert clean.normalise("“q” ’s ﬁ") == "\"q\" 's fi"
    assert clean.dehyphenate("termi-\nnation non-\ncompete x-\nself-\nx") == "termination non-compete xselfx"
    assert clean.drop_layout("Page 2 of 9\n12\n1.2) a\niv) b\n(a) c").split("\n")[-3:] == ["a", "b", "(a) c"]
    assert clean.drop_headers(["h", "x", "h", "y", "h", "z", "z", *["l" * 60] * 3]) == ["x", "y", "z", "z", *["l" * 60] * 3]
    wide = "this line is as wide as the others in it"
    assert clean.rejoin([wide, "goes on", "", "Not", "T" + wide[1:] + ".", "Next", "Pvt.", "and so"]) == [wide + " goes on", "", "Not", "T" + wide[1:] + ".", "Next", "Pvt. and so"]
    assert clean.clean(None) == "" and clean.clean(" a \t b\n\n\nC ") == "a b\nC"
    assert clean.normalise_numbers("6 (six) months, 30 (thirty) days'") == "6 months, 30 days'"


def test_typed_tokens():
    want = [
        ("₹12,00,000", "MONEY"), ("Rs. 5,000/-", "MONEY"), ("INR 3.5 lakhs", "MONEY"), ("Section 27", "STATUTE"), ("Indian Contract Act, 1872", "STATUTE"), ("Clause 4.2(a)", "CLAUSE"), ("01/04/2026", "DATE"),
        ("9:30 a.m.", "TIME"), ("w.e.f.", "ABBR"), ("Pvt.", "ABBR"), ("non-compete", "HYPHEN"), ("1,000", "NUMBER"), ("word's", "WORD"), (";", "PUNCT"),
    ]
    for text, kind in want:
        assert tokens.typed(text) == [(text, kind)]
    assert tokens.custom("3rd a_b naïve 2026-04-01") == ["rd", "a", "b", "na", "ve", "2026", "-", "04", "-", "01"]  # what the classes leave out


def test_tokenizers():
    text = "The CTC is ₹12,00,000 per Section 27; a non-compete applies w.e.f. today. He can't go."
    merged = tokens.hybrid(text)
    assert {"₹12,00,000", "Section 27", "non-compete", "w.e.f."} <= set(merged) and "ca" in merged and "n't" in merged
    assert "".join("".join(merged).split()) == "".join(text.split())
    assert tokens.word_punct("a-b c!!") == ["a", "-", "b", "c", "!!"] and tokens.whitespace(" a  b ") == ["a", "b"]
    assert tokens.sentences("Mr. Rao of X Pvt. Ltd. left. He shan't. Mr. B. came\nNew line") == ["Mr. Rao of X Pvt. Ltd. left.", "He shan't.", "Mr. B. came", "New line"]
    assert tokens.terms(["A", "a", "-", "b1"]) == {"a", "b1"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8)), max_size=12))
def test_longest_first(pairs):
    spans = [(a, a + n, str(k)) for k, (a, n) in enumerate(pairs)]
    got, free = [], set(range(60))
    for a, b, label in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
        if set(range(a, b)) <= free:
            got.append((a, b, label))
            free -= set(range(a, b))
    assert tokens.longest_first(spans) == sorted(got)


PUBLISHED = {
    "porter": dict(caresses="caress", ponies="poni", cats="cat", agreed="agre", plastered="plaster", motoring="motor", hopping="hop", falling="fall", filing="file", happy="happi", relational="relat", generalization="gener", oscillators="oscil"),
    "snowball": dict(consign="consign", consigned="consign", consistency="consist", knackeries="knackeri", generate="generat", general="general", ties="tie", happy="happi", skies="sky", knightly="knight"),
    "lancaster": dict(maximum="maxim", presumably="presum", multiply="multiply", provision="provid", owed="ow", ear="ear", saying="say", string="string", meant="meant"),
}


@pytest.mark.parametrize("name", PUBLISHED)
def test_published_stems(name):
    assert {w: stem.STEMMERS[name](w) for w in PUBLISHED[name]} == PUBLISHED[name]


@pytest.mark.parametrize(
    ("text", "groups"),
    [
        ('"a" "b"', [["a", "b"]]), ("a b", [["a b"]]), ("NOT a", [["-a"]]), ("a NOT b", [["a", "-b"]]), ("NOT NOT a", [["a"]]), ("a NOT OR b", [["a"], ["-b"]]), ("a AND", [["a"]]), ("a OR", [["a"]]),
        ("a NOT", [["a"]]), ("AND OR", []), ("", []), ('"x AND y"', [["x AND y"]]), ("a and b", [["a and b"]]), ('a "b', [["a b"]]), ("AND-x b", [["-x b"]]), ("a AND b OR c", [["a", "b"], ["c"]]),
    ],
)
def test_query_grammar(text, groups):
    want = [[Operand(x[1:], True) if x[0] == "-" and text != "AND-x b" else Operand(x) for x in g] for g in groups]
    assert query.parse(text) == want


def test_query_types():
    assert [query.query_type(q) for q in ("a", '"a b"', "a b c", "a b c d", "", "a AND b", "a OR b NOT c", '"x OR y"')] == ["Unigram", "Bigram", "Trigram", "4-gram phrase", "0-gram phrase", "Boolean AND", "Boolean NOT", "Boolean OR"]
    assert query.build_query("phrase", " a b ") == '"a b"' and query.build_query("boolean", "a b c", "NOT") == "a NOT b NOT c"


def test_amounts():
    assert ocr.repair_amounts("¥5 x", "off") == ("¥5 x", 0, 0)
    assert ocr.repair_amounts("¥500, 5,00,000/- and 12,00,000") == ("₹500, ₹5,00,000/- and ₹12,00,000", 3, 0)
    assert ocr.repair_amounts("12,00,000 shares; Rs. 12,00,000; pay of 15,000; 15,000 far") == ("12,00,000 shares; Rs. 12,00,000; pay of 15,000; 15,000 far", 0, 2)
    assert ocr.repair_amounts("salary 15,000", "context") == ("salary ₹15,000", 1, 0)


def test_tagging():
    assert annotate.tag_domain(["The", "Employee", "shall", "bond", "the", "CTC", "."]) == ["DT", "NN", "MD", "VB", "DT", "NN", "."]
    assert annotate.tag_domain(["shall", "not", "claim"])[2] == "VB" and annotate.tag_domain(["the", "claim"])[1] == "NN" and annotate.tag_domain(["₹5"]) == ["CD"]
    assert annotate.tag_domain(["Notice"]) == annotate.tag(["Notice"]) and annotate.override(["x", "bond"], ["TO", "NN"]) == ["TO", "VB"] and annotate.override(["not", "bond"], ["RB", "XX"]) == ["RB", "XX"]
    assert annotate.override(["company", "his", "service", "to", "release"], ["X", "PRP$", "VBZ", "TO", "NN"]) == ["NN", "PRP$", "NN", "TO", "VB"]
    assert annotate.tag_shapes(["The", "Employee", "quickly", "signed", "24", "bonds", "."]) == ["DT", "NNP", "RB", "VBN", "CD", "NNS", "."]


def test_pipelines():
    text = "The Employee shall not disclose 6 (six) months of non-compete data. ₹12,00,000 was paid."
    final = pipelines.flat("Final Pipeline", text)
    assert {"not", "shall", "non-compete", "₹12,00,000", "employee", "month", "pay"} <= set(final) and "the" not in final
    assert "not" not in pipelines.flat("Pipeline A", text) and "the" in pipelines.flat("Pipeline B", text)
    assert pipelines.query_terms("Final Pipeline", "training", {"training": "train"}) == ["train"] and pipelines.query_terms("Pipeline A", "the") == []
    assert not (words.PROTECTED_WORDS & words.CUSTOM_STOP_WORDS) and words.ARCHAIC_WORDS <= words.CUSTOM_STOP_WORDS

import pytest
from pyspark.sql import functions as F

from surveyq.functions import text as X


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).head()["x"]


CASES = [
    (X.norm_title, "Deep Learning: A Survey (2nd ed.)", "deeplearningasurveynded"),
    (X.norm_alnum, "GPT-4 & co", "gpt4co"),
    (X.norm_words, " GPT-4 & co. ", "gpt 4 co"),
    (X.norm_loose, "Été: l'art,  vraiment", "été lart vraiment"),
    (X.clean_web_title, "[1911.02794] A Title - arXiv", "A Title"),
    (X.clean_web_title, "[PDF] Some Title ...", "Some Title"),
    (X.clean_web_title, "Paper name – www.site.org/x", "Paper name"),
    (X.clean_web_title, None, ""),
    (X.clean_query_title, "(2017). Attention is all you need. In Advances in NIPS, pp. 5998-6008", "Attention is all you need"),
    (X.clean_query_title, "Proceedings of X", "Proceedings of X"),
    (X.clean_query_title, "Some nice title 680-686.", "Some nice title"),
    (X.clean_query_title, " ".join(f"w{i}" for i in range(30)), " ".join(f"w{i}" for i in range(20))),
    (X.clean_latex_title, r"A \textbf{Bold}~Title\\[2pt] with $x$ {Braces}.", "A Bold Title with x Braces"),
    (X.clean_latex_fragment, r"\newblock \emph{On ``quotes''} \natexlab{a}~\url{http://x}.", 'On "quotes" http://x'),
    (X.bare_arxiv, "2301.12345v3", "2301.12345"),
    (X.arxiv_id, "see https://arxiv.org/pdf/2301.12345v2", "2301.12345"),
    (X.arxiv_id, "nothing", None),
    (X.first_url, r"a \href{http://h}{t} http://b.", "http://h"),
    (X.first_url, "see http://b.org/x, and", "http://b.org/x"),
    (X.first_url, "none", None),
    (X.bib_title, r"\bibinfo{title}{Big Things}", "Big Things"),
    (X.bib_title, "A. Author, ``A quoted title,'' Venue", "A quoted title"),
    (X.bib_title, "A. Author.\n\\newblock The title.\n\\newblock Venue", "The title"),
    (X.bib_title, "plain entry", "plain entry"),
    (X.last_name, "Doe, John", "doe"),
    (X.last_name, "J. R. Doe", "doe"),
    (X.last_name, "X", None),
    (X.keywords, "A Survey of Graph Networks: an overview", ["Graph", "Networks"]),
    (X.keywords, "A Survey of", ["A", "Survey", "of"]),
    (X.arxiv_ids, "arXiv:2301.12345v2 arxiv.org/abs/1706.03762 9913.00001 2301.12345", ["2301.12345", "1706.03762"]),
    (X.citations, "a [1] b [2, 3] c [4](#x) d [5][6] [x]", [1, 2, 3, 5, 6]),
    (X.strip_json_fence, "```json\n{\"a\": 1}\n```", '{"a": 1}'),
    (X.first_json_object, 'x {"a": {"b": 1}} y', '{"a": {"b": 1}}'),
    (X.strip_markup, "<jats:p>a  <b>c</b></jats:p>", "a c"),
    (X.slug, "a/b c:d", "a_b_c_d"),
    (X.parse_score, "SCORE: 150", 100),
    (X.parse_score, "I give 3 or rather 7", 7),
    (X.parse_score, "no 42", None),
    (X.parse_winner, "winner: tie", "TIE"),
    (X.parse_winner, "Survey B is clearly better", "B"),
    (X.parse_winner, "dunno", None),
    (X.parse_level, " 4\n", 4),
    (X.parse_level, "45", None),
    (X.parse_claim_lines, "- One claim.\n2. Two claims.\n\nNote: x", ["One claim.", "Two claims."]),
    (X.parse_claim_lines, "No verifiable claim.", []),
    (X.clean_markdown, "# A {#sec:a}\nx\n\n\n\n\nb {width=3}\n", "# A\nx\n\nb\n"),
    (X.outline, "x\n# A\n  ## B\ny", "# A\n## B"),
    (X.outline_sections, "1. Introduction:\n## Methods used\n- x\n# abc", ["Introduction", "Methods used"]),
    (X.word_count, "  a b\n c ", 3),
    (X.word_count, None, 0),
    (X.split_line_sentences, "First one. Second one.\n\n- item here\n", ["First one.", "Second one.", "- item here"]),
]


@pytest.mark.parametrize("function,value,want", CASES, ids=lambda x: getattr(x, "__name__", None))
def test_function(spark, function, value, want):
    assert one(spark, function(F.lit(value).cast("string"))) == want


TEXT = "Preamble is dropped here for sure, yes.\n# One\nThis is a first sentence of the text [1, 2]. And this is the second sentence of it.\n\nAnother paragraph that is long enough.\n## Two\nshort.\n### Three\nA last sentence that is long enough to stay."


def test_sentences_and_sections(spark):
    assert one(spark, X.split_sentences(F.lit("A short one. This sentence [12] is longer than thirty chars. And so is this one, by some margin!"))) == [
        "This sentence is longer than thirty chars.", "And so is this one, by some margin!"]
    got = one(spark, X.split_sections(F.lit(TEXT)))
    assert [(s.title, len(s.sentences), len(s.paragraphs)) for s in got] == [("One", 3, 2), ("Three", 1, 1)]
    whole = one(spark, X.split_sections(F.lit("No headings here but a sentence that is long enough.")))
    assert [(s.title, len(s.sentences)) for s in whole] == [("Full text", 1)]


def test_headings(spark):
    got = one(spark, X.headings(F.lit("ab\n# A\nx\n### B\n#nope\n## C")))
    assert [(h.start, h.end, h.level) for h in got] == [(3, 9, 1), (9, 21, 3), (21, 25, 2)]
    assert one(spark, X.headings(F.lit("none"))) == []


def test_windows(spark):
    s = F.array(*(F.lit(f"s{i}") for i in range(7)))
    assert one(spark, X.excerpt(s, F.lit(3), 1, 2)) == "[...]\ns2\ns3\ns4\ns5\n[...]"
    assert one(spark, X.excerpt(s, F.lit(0), 2, 0)) == "s0\n[...]"
    assert one(spark, X.snippet(s, F.lit(5))) == "s0 s2 s3 s4 <SOS>s5<EOS> s6"
    assert one(spark, X.snippet(F.array(F.lit("a"), F.lit("b")), F.lit(0))) == "<SOS>a<EOS> b"
    assert one(spark, X.word_chunks(s, F.lit(800), 350)) == ["s0 s1", "s2 s3", "s4 s5", "s6"]
    full = "This is the very first sentence here. This is the second sentence of all. The third one closes the text, really."
    got = one(spark, X.sentence_window(F.lit(full), F.lit("This is the second sentence of all."), 1))
    assert (got.paragraph_start, got.paragraph_end, got.window_start, got.window_end, got.total) == (2, 2, 1, 3, 3)
    assert one(spark, X.sentence_window(F.lit(full), F.lit("Something else that is nowhere to be found."))) is None


def test_references(spark):
    text = "Body [1].\n## References\n[1] First title URL: https://arxiv.org/abs/1706.03762\n2. Second title\nnoise\n# Appendix\n[3] not here"
    got = one(spark, X.reference_lines(F.lit(text)))
    assert [(r.idx, r.title, r.arxiv_id) for r in got] == [(1, "First title", "1706.03762"), (2, "Second title", None)]
    refs = F.array(F.struct(F.lit(1).alias("idx"), F.lit("T").alias("title"), F.lit("C").alias("canonical_title")))
    assert one(spark, X.replace_references(F.lit("Intro\n\n## References\nold\n\n## Next\nx"), refs)) == "Intro\n\n## References\n\n[1] C\n\n## Next\nx"
    assert one(spark, X.replace_references(F.lit("Intro\n"), refs)) == "Intro\n\n## References\n\n[1] C"
    assert one(spark, X.author_year_references(F.lit("x [Smith et al., 2020] y\n# References\nA line\n# stop\n[Smith et al., 2020]"))) == ["Smith et al., 2020", "A line", "[Smith et al., 2020]"]


def test_model_answers(spark):
    sel = one(spark, X.parse_selection(F.lit("...\nFinal submission:\nContains a specific and verifiable proposition\n\nSentence with only verifiable information:\nIt is so.\n\n"), F.lit("orig")))
    assert (sel.ok, sel.verifiable, sel.sentence) == (True, True, "It is so.")
    sel = one(spark, X.parse_selection(F.lit("Final submission: Does NOT contain a specific and verifiable proposition"), F.lit("orig")))
    assert (sel.ok, sel.verifiable, sel.sentence) == (True, False, None)
    assert one(spark, X.parse_selection(F.lit("junk"), F.lit("o"))).ok is False
    assert one(spark, X.parse_disambiguation(F.lit("DecontextualizedSentence: Whole one.\n\nx"))).sentence == "Whole one."
    assert one(spark, X.parse_disambiguation(F.lit("DecontextualizedSentence: Cannot be decontextualized"))).sentence is None
    said = X.PROPOSITIONS + '\n["old"]\n' + X.PROPOSITIONS + '\n[\n"A is B - true or false?",\n"C & D",\n]\nthanks'
    got = one(spark, X.parse_decomposition(F.lit(said)))
    assert got.ok and got.claims == ["A is B", "C & D"]
    assert one(spark, X.parse_decomposition(F.lit("none"))).ok is False


def test_titles_and_text_index(spark):
    assert one(spark, X.title_score(F.lit("A B"), F.lit("a-b"))) == 1.0
    assert one(spark, X.title_score(F.lit("A B"), F.lit("a b c"))) == 0.9
    assert one(spark, X.title_score(F.lit("A B"), F.lit("x y"))) == 0.0 == one(spark, X.title_score(F.lit(""), F.lit("x")))
    assert one(spark, X.title_score_words(F.lit("big red cat"), F.lit("red big dog"))) == pytest.approx(2 / 3)
    index = F.create_map(F.lit("b"), F.array(F.lit(1), F.lit(3)), F.lit("a"), F.array(F.lit(0)), F.lit("c"), F.array(F.lit(2)))
    assert one(spark, X.text_from_index(index)) == "a b c b"
    tagged = one(spark, X.split_tagged_sentences(F.lit("[A.S1] First. [A.S2] Second.\n[B.S1] Third")))
    assert [(t.id, t.sentence) for t in tagged] == [("A.S1", "First."), ("A.S2", "Second."), ("B.S1", "Third")]

"""The engine's operators on small rows: text functions, markup, packing, cache, engines, glossaries, lexicon, quality, archives."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from versomill.functions import text as X
from versomill.operators import cache, engines, glossary, lexicon, markup, packing, quality, report, segments, toc, translate
from versomill.sources import epub, files, pages, sinks
from versomill.streaming import resume


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).collect()[0]["x"]


def test_text_functions(spark):
    assert one(spark, X.collapse(F.col("t")), t=" a  \n b ") == "a b"
    assert one(spark, X.escape(F.col("t")), t="<a & b>") == "&lt;a &amp; b&gt;"
    assert one(spark, X.plain_placeholders(F.col("t")), t="<g1>a</g1><x2/>b &amp; c") == "a b & c"
    assert one(spark, X.plain_spaced(F.col("t")), t="<g1>a</g1>b") == "a b"
    assert one(spark, X.skeleton(F.col("t")), t="Balloon") == "bln"
    assert one(spark, X.sentences(F.col("t")), t="One. two. Three! “Four”") == ["One. two.", "Three!", "“Four”"]
    assert one(spark, X.ranges(F.lit("1-3, 5"))) == [1, 2, 3, 5]
    assert one(spark, X.apostrophe_words(F.lit("Della'nın it’s 3 x"))) == ["Della", "it", "x"]
    assert one(spark, X.without_addresses(F.lit("see http://a.b/c or x@y.org now"))).split() == ["see", "or", "now"]
    assert one(spark, X.restore_case(F.lit("ISTANBUL"), F.lit("ist"), "tr")) == "İST"
    assert one(spark, X.slug(F.lit("A <b>Small</b> Title, here!"))) == "a-small-title-here"
    assert one(spark, X.language_name(F.lit("tr-TR"))) == "Turkish"
    assert one(spark, X.language_name(F.lit("xx"))) == "xx"
    assert [one(spark, X.wait_seconds(F.lit(a), F.lit(limited))) for a, limited in ((0, True), (3, True), (2, False))] == [15.0, 90.0, 8.0]
    assert one(spark, X.segment_frames(F.lit('<seg id="1">a</seg> x <SEG id=2> b\n</seg>'))) == [(1, "a"), (2, "b")]
    assert one(spark, X.glossary_lines(F.lit("x <glossary>\n- Della => Della\n* b =>c\n no\n"))) == [("Della", "Della"), ("b", "c")]
    assert one(spark, X.repeats_thrice(F.split(F.lit("a b b b"), " "))) and not one(spark, X.repeats_thrice(F.split(F.lit("b b a b"), " ")))


@pytest.mark.parametrize(
    "source, result, want",
    [("<g1>Title</g1>", "Başlık", "<g1>Başlık</g1>"), ("Title", '"Başlık"', "Başlık"), ('"Title"', '"Başlık"', '"Başlık"'), ("<g1>a</g1> b", "c", "c"), ("<g1>a</g1>", "<g1>c</g1>", "<g1>c</g1>"), ("Title", "«Başlık»", "«Başlık»")],
)
def test_rewrap(spark, source, result, want):
    assert one(spark, X.rewrap(F.col("s"), X.plain_placeholders(F.col("s")), F.col("r")), s=source, r=result) == want


def block(text):
    return markup.parse(text)[2][0]


def test_encode_and_decode():
    node = block("<p>A <i>b <b>c</b></i><br/> &amp; <!-- no --> d<img src='x'></p>")
    source, found = markup.encode(node)
    assert source == "A <g1>b <g2>c</g2></g1><x3/> &amp; d<x4/>"
    assert markup.plain(source) == "A b c & d"
    children, ok = markup.decode("<g1>B <g2>C</g2></g1> < X3 / > a &amp; d <x4/>", found)
    assert ok and markup.serialise(["p", {}, children]) == '<p><i>B <b>C</b></i> <br/> a &amp; d <img src="x"/></p>'


@pytest.mark.parametrize("bad", ["<g1>a</g1>", "a", "<x1/><x2/>", "<g1>a<x2/></g1><x2/>", "</g1>a<g1><x2/>", "<g1/>a<x2/>", "<g1>a</g1><x2/><g3>b</g3>", "<g1>a<x2/>"])
def test_placeholders_that_do_not_fit(bad):
    kinds = {1: "g", 2: "x"}
    assert markup.problem(bad, kinds) is not None
    assert markup.problem("< G1 >a</g1> <X2 />", kinds) is None
    with pytest.raises(ValueError):
        markup.decode(bad, {1: ("g", ["i", {}, []]), 2: ("x", ["br", {}, []])})
    children, ok = markup.decode(bad, {1: ("g", ["i", {"id": "k"}, []]), 2: ("x", ["br", {}, []])}, strict=False)
    assert not ok and [c[0] for c in children if not isinstance(c, str)] == ["i", "br"]


def test_segments_of_a_document():
    text = """<html><head><title>no</title></head><body><section id="pg-header"><p>no</p></section><h1>Title</h1><p>One <i>two</i>
    <div><p>inner</p>loose</div><p class="a notranslate">no</p><p translate="no">no</p><pre>if (a) { b; }\nc = d;</pre><p>123</p><ul><li>item</li></ul><b>bold</b></body></html>"""
    got = [(s["kind"], s["plain"]) for s in markup.segments(markup.parse(text))]
    assert got == [("heading", "Title"), ("text", "One two"), ("text", "inner"), ("text", "item"), ("text", "bold")]
    numbers = [s["seg_no"] for s in markup.segments(markup.parse(text))]
    assert numbers == sorted(set(numbers)) and numbers != list(range(1, len(numbers) + 1))
    nav = markup.segments(markup.parse("<body><nav><ol><li><a href='x'>One</a></li></ol><a href='y'>Two</a></nav></body>"), is_nav=True)
    assert [(s["kind"], s["source"]) for s in nav] == [("text", "<g1>One</g1>"), ("toc", "Two")]


def test_prose_and_boilerplate():
    root = markup.parse("<body><pre>\nA poem\n  of two lines\n</pre><pre>def f(x):\n  return {x};\n</pre><p>*** START OF THIS PROJECT GUTENBERG EBOOK</p>tail<div class='x pg-boilerplate'>no</div></body>")
    assert markup.prose_pre(root) and markup.strip_boilerplate(root)
    out = markup.serialise(root)
    assert '<p class="pre-poem">A poem<br/>of two lines</p>' in out and "<pre>def" in out and "tail" in out and "GUTENBERG" not in out and "pg-boilerplate" not in out


def test_greedy_batches(spark):
    r = random.Random(1)
    rows = [(g, k, "x" * r.choice([0, 5, 90, 150])) for g in range(4) for k in range(60)]
    got = packing.greedy_batches(spark.createDataFrame(rows, "g int, k long, t string"), "g", "k", "t", 200, 7).collect()
    assert len(got) == len(rows)
    sizes = {}
    for x in got:
        sizes.setdefault((x["g"], x["batch_no"]), []).append(len(x["t"]))
    for (g, n), s in sizes.items():
        assert len(s) <= 7 and (sum(s) <= 200 or len(s) == 1)
    for g in range(4):
        chars = items = batch = 0
        for x in sorted((x for x in got if x["g"] == g), key=lambda x: x["k"]):
            if not items or chars + len(x["t"]) > 200 or items >= 7:
                batch, chars, items = batch + 1, 0, 0
            chars, items = chars + len(x["t"]), items + 1
            assert (x["batch_no"], x["local_id"]) == (batch, items)


def test_byte_chunks(spark):
    r = random.Random(2)
    for _ in range(5):
        text = " ".join("".join(r.choice("aöçz.") for _ in range(r.randint(1, 30))) for _ in range(60)) + " " + "ğ" * 200
        got = one(spark, packing.byte_chunks(F.col("t"), 120), t=text)
        assert got == engines.split_bytes(text, 120)
        assert all(len(p.encode()) <= 120 for p in got)
        assert "".join(got).replace(" ", "") == text.replace(" ", "")


def test_context(spark):
    rows = spark.createDataFrame([(1, k, "abcd", "xy") for k in range(6)], "d int, k int, s string, t string")
    assert [x["context"] for x in packing.context_before(rows, "d", "k", "s", 2).orderBy("k").collect()][:4] == [[], ["abcd"], ["abcd"] * 2, ["abcd"] * 2]
    assert all(x["context"] == [] for x in packing.context_before(rows, "d", "k", "s", 0).collect())
    left = {x["k"]: (x["source_cut"], x["target_cut"]) for x in packing.budgeted_context(rows, "d", "k", "s", "t", 13).collect()}
    assert left == {5: ("abcd", "xy"), 4: ("abcd", "xy"), 3: ("a", "x")}
    runs = packing.runs(spark.createDataFrame([(1, k, k in (1, 2, 5)) for k in range(7)], "d int, k int, good boolean"), "d", "k", "good")
    assert sorted((x["first"], x["last"]) for x in runs.collect()) == [(1, 2), (5, 5)]


SEGMENTS = "doc_index long, seg_no long, uid string, kind string, source string, plain string"


@pytest.fixture
def three(spark):
    rows = [(0, 1, "0:1", "heading", "One", "One"), (0, 2, "0:2", "text", "<g1>Two</g1>", "Two"), (1, 1, "1:1", "text", "Three", "Three")]
    return spark.createDataFrame(rows, SEGMENTS)


def test_translate_caches_and_resumes(spark, three, tmp_path):
    done, rows, log = translate.translate(three, ["upper"], None, "en", "tr", pause=False)
    assert {x["uid"]: x["translation"] for x in done.collect()} == {"0:1": "ONE", "0:2": "<g1>TWO</g1>", "1:1": "THREE"}
    assert [(x["engine"], x["ok"]) for x in log.collect()] == [("upper", True)] * 2
    path = f"{tmp_path}/cache"
    cache.write(cache.upsert(cache.read(spark, path), rows, "key"), path)
    again, new, log = translate.translate(three, ["upper"], cache.read(spark, path), "en", "tr", pause=False)
    assert again.where("hit").count() == 3 and new.count() == 0 and log.count() == 0
    other, _, _ = translate.translate(three, ["upper"], cache.read(spark, path), "en", "de", pause=False)
    assert other.where("hit").count() == 0


def test_llm_chunks_are_taken_whole(spark, three):
    engines.register("fake", lambda: engines.Engine("fake", lambda t: [f"F {x}" for x in t], is_llm=True))
    name = [n for n in ("openai",)]
    keyed = cache.keyed(three, "openai", None, "llm", "en", "tr").where("uid = '0:1'").select("key", F.lit("cached").alias("result"))
    done, _, _ = translate.translate(three, [*name, "upper"], keyed, "en", "tr", pause=False)
    # one of two segments of the chunk is cached: the chunk goes to the engines as a whole
    assert {x["uid"]: x["translation"] for x in done.collect()}["0:1"] == "ONE"


def test_retries_and_chain():
    calls, pauses = [], []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise engines.RateLimited("429")
        return [f"a {t}" if t != "y" else None for t in texts]

    e = engines.Engine("flaky", flaky)
    result, log = engines.call(e, ["x"], 3, pauses.append)
    assert result == ["a x"] and [r["ok"] for r in log] == [False, False, True] and pauses == [15, 30]

    def unavailable(texts):
        raise engines.EngineUnavailable("not here")

    gone = engines.Engine("gone", unavailable)
    out, log = engines.through_chain([gone, e, engines.make("echo")], ["x", "y"], 3, pauses.append)
    assert out == [("a x", "flaky"), ("y", "echo")]
    assert [(r["engine"], r["error_class"]) for r in log][0] == ("gone", "EngineUnavailable")
    short = engines.Engine("short", lambda t: t[:-1])
    assert engines.call(short, ["x", "y"], 2, pauses.append)[0] is None
    with pytest.raises(SystemExit):
        engines.make("nothing")


def test_engine_listing(spark):
    rows = {r["engine"]: r["status"] for r in engines.availability(spark).collect()}
    assert "echo" not in rows and rows["upper"] == "ok" and rows["argos"].startswith("unavailable")


def test_glossaries(spark):
    answers = spark.createDataFrame([(0, 1, "Della met Jim", "<glossary>\nDella => Della\nJim => Cim\nAnn => x</glossary>"), (0, 2, "Jim again", "<glossary>Jim => Jim\n => y")], "doc_index int, chunk_no int, chunk string, answer string")
    assert {r["term"]: r["target"] for r in glossary.accepted(answers, "chunk", "answer", "doc_index", "chunk_no").collect()} == {"Della": "Della", "Jim": "Cim"}
    requests = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "chunk_no int, local_id int")
    found = spark.createDataFrame([(1, '<seg id="1">a</seg><seg id="2"></seg><seg id="9">z</seg><seg id="1">b</seg>')], "chunk_no int, answer string")
    assert [r["text"] for r in glossary.answers_by_id(requests, found, "chunk_no").orderBy("local_id").collect()] == ["b", None, None]
    names = spark.createDataFrame([(1, "So Della ran. The dog saw Della and Jim. Then Jim sat with Christmas and Christmas. A house and House and House here")], "k int, t string")
    assert [(r["name"], r["n"]) for r in glossary.detect_names(names, "t", "k").collect()] == [("Della", 2), ("Jim", 2)]
    prompt = one(spark, glossary.user_prompt(F.create_map(F.lit("a"), F.lit("b")), F.array(F.lit("Jim")), F.array(F.lit("s")), F.array(F.lit("t")), F.lit("en"), F.lit("tr"), F.array(F.lit(1)), F.array(F.lit("x"))))
    assert "a => b" in prompt and "Names: Jim" in prompt and "s => t" in prompt and '<seg id="1">x</seg>' in prompt and "English into Turkish" in prompt
    assert "dash" in one(spark, glossary.system_prompt(F.lit("en"), F.lit("tr"), F.lit("dash")))


def test_glossary_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# no\n\nDella => Della\nJim\tCim\nx = y = z\nnothing\nJim = Jim\n")
    (tmp_path / "b.json").write_text(json.dumps({"a": "b"}))
    assert {r["term"]: r["target"] for r in files.glossary(spark, f"{tmp_path}/a.txt").collect()} == {"Della": "Della", "Jim": "Jim", "x": "y = z"}
    assert [tuple(r) for r in files.glossary(spark, f"{tmp_path}/b.json").collect()] == [("a", "b")]


def test_event_streams_and_reports(spark):
    stream = 'noise\n{"type":"text","part":{"text":"a"}}\n{bad\n{"type":"error","error":"e1"}\n{"type":"text","part":{"text":"b"}}'
    assert one(spark, files.event_text(F.lit(stream))) == "ab"
    assert one(spark, files.event_text(F.lit("\x1b[31mplain\x1b[0m"))) == "plain"
    assert one(spark, files.event_errors(F.lit(stream))) == ["e1"]
    found = spark.createDataFrame([(json.dumps({"messages": [{"ID": "B", "severity": "ERROR", "message": "m"}, {"ID": "A", "severity": "FATAL", "message": "n"}, {"ID": "C", "severity": "INFO", "message": "o"}]}),)], "value string")
    assert [r["error"] for r in files.validator_errors(found).collect()] == ["A n", "B m"]
    text = spark.createDataFrame([("f", "# One\n[a](x.md#b)\n## Two\n# One\n```\n# no\n```\n")], "file string, text string")
    heads = report.numbered_slugs(files.markdown_headings(text), F.col("heading"), ["file"], ["pos"])
    assert [r["anchor"] for r in heads.orderBy("pos").collect()] == ["one", "two", "one-1"]
    assert [(r["path"], r["anchor"]) for r in files.markdown_links(text).collect()] == [("x.md", "b")]
    assert one(spark, files.changelog_section(F.lit("# L\n## 1.1\nb\nc\n## 1.0\nd\n"), "1.1")) == "b\nc"


LEXICON = [("en", "house", 5.0), ("en", "so", 6.0), ("en", "soon", 5.0), ("en", "hearth", 3.5), ("en", "rug", 3.6), ("en", "table", 4.5), ("tr", "table", 4.0), ("tr", "ev", 5.0), ("en", "balloon", 3.4), ("en", "together", 5.0)]


def test_lexicon_operators(spark):
    known = spark.createDataFrame(LEXICON, "lang string, word string, zipf double")
    words = spark.createDataFrame([(w,) for w in ("house", "House", "HOUSE", "table", "the", "xiv", "on", "ev", "ğa", "a")], "word string")
    rows = lexicon.with_frequencies(words, known, "en", "tr").select("word", lexicon.is_source_word(F.col("word"), F.col("s"), F.col("t")).alias("x"))
    assert {r["word"] for r in rows.collect() if r["x"]} == {"house", "HOUSE", "the"}
    assert [r["word"] for r in lexicon.compounds(spark.createDataFrame([("Hearthrug",), ("housetop",)], "word string"), known, "en").collect()] == ["hearthrug"]
    fixed = {r["word"]: r["fixed"] for r in lexicon.unstretched(spark.createDataFrame([("So—o",), ("to—gether",), ("so—so",), ("house—table",)], "word string"), known, "en").collect()}
    assert fixed == {"So—o": "So", "to—gether": "together", "so—so": "so—so", "house—table": "house—table"}
    near = lexicon.nearest_word(spark.createDataFrame([("baloon",), ("zzz",)], "word string"), known, "en").collect()
    assert [(r["word"], r["fixed"]) for r in near] == [("baloon", "balloon")]
    pairs = lexicon.joined_over_break(spark.createDataFrame([("to", "gether"), ("house", "table")], "a string, b string"), known, "en")
    assert {r["a"]: r["joined"] for r in pairs.collect()} == {"to": True, "house": False}
    facts = {r["word"]: (r["seen_lower"], r["n_capitals"]) for r in lexicon.source_facts(spark.createDataFrame([("The House stood. A house.",)], "t string"), "t").collect()}
    assert facts["house"] == (True, 1)
    nouns = lexicon.capitalised_common_nouns(spark.createDataFrame([("House",), ("Della",)], "word string"), lexicon.source_facts(spark.createDataFrame([("The house and Della.",)], "t string"), "t"), known, "en", "tr")
    assert [r["word"] for r in nouns.collect()] == ["House"]


def test_quality_rules(spark):
    source = "A sentence of a reasonable length stands here."
    rows = [(source, source, ["leftover", "same"]), (source, "kısa", ["length"]), (source, "çok çok çok uzun bir cümle burada duruyor işte", ["repeat"]), (source, "Burada makul uzunlukta bir cümle duruyor işte", []), ("short", "short", [])]
    df = spark.createDataFrame(rows, "s string, t string, want array<string>")
    for r in quality.flagged(df, "s", "t").collect():
        assert r["flags"] == r["want"]
    cands = spark.createDataFrame([("0:1", 0, "current", source, "x", "nothing alike"), ("0:1", 1, "a", source, "Burada makul uzunlukta bir cümle duruyor işte", source), ("0:1", 2, "b", source, "Burada makul uzunlukta bir cümle duruyor işte", source)], "uid string, cand_order int, name string, source string, text string, back string")
    best = quality.best_candidate(quality.scored(cands, "source", "text", "back"), "uid")
    assert best.collect()[0]["name"] == "a"
    segs = spark.createDataFrame([("0:1", source, "x"), ("0:2", source, "y")], "uid string, source string, translation string")
    new, log = quality.improved(segs, best)
    assert {r["uid"]: r["translation"][:6] for r in new.collect()} == {"0:1": "Burada", "0:2": "y"} and log.count() == 1
    done = translate.polished(segs, spark.createDataFrame([("0:1", "better", True), ("0:2", "bad", False)], "uid string, translation string, valid boolean"))
    assert {r["uid"]: r["translation"] for r in done.collect()} == {"0:1": "better", "0:2": "y"}


def test_contents_and_title(spark):
    heads = spark.createDataFrame([(1, 1, "One", "Bir"), (2, 1, "one ", "İki")], "doc_index int, seg_no int, plain string, translation string")
    labels = spark.createDataFrame([("<g1>One</g1>", "One", "x"), ("One", "One", "y"), ("<g1>O</g1>ne", "One", "z"), ("Two", "Two", "w")], "source string, plain string, translation string")
    got = {r["source"]: r["translation"] for r in toc.harmonised(labels, heads, "doc_index", "seg_no").collect()}
    assert got == {"<g1>One</g1>": "<g1>Bir</g1>", "One": "Bir", "<g1>O</g1>ne": "z", "Two": "w"}
    books = spark.createDataFrame([("b", " ONE")], "book_id string, title string")
    assert toc.title(books, heads.withColumns({"book_id": F.lit("b"), "kind": F.lit("heading")}), True).collect()[0]["new_title"] == " ONE / Bir"


def test_reports(spark):
    calls = spark.createDataFrame([("a", 1, False, "RateLimited", 1.0), ("a", 2, True, None, 2.0), ("b", 3, False, "EngineError", 0.5)], "engine string, k int, ok boolean, error_class string, seconds double")
    assert {r["engine"]: (r["calls"], r["failures"]) for r in report.engine_stats(calls).collect()} == {"a": (2, 1), "b": (1, 1)}
    assert report.first_errors(calls, "k", shown=1).collect()[0]["errors"] == ["RateLimited"]
    rows = spark.createDataFrame([("s", "t", "e", "u"), ("s", None, None, "v")], "source string, translation string, engine string, uid string")
    summary = report.summary(rows)
    assert summary.collect()[0]["exit_code"] == 2
    assert json.loads(sinks.summary_json(summary, spark.createDataFrame([("a", "b")], "term string, target string")).collect()[0]["value"])["glossary"] == {"a": "b"}
    assert [json.loads(r["value"])["translation"] for r in sinks.dump_rows(rows, "uid").collect()] == ["t", None]
    wide = report.run_comparison(spark.createDataFrame([("u", "a", "x", "s"), ("u", "b", "y", "s")], "uid string, run string, t string, source string"), ["uid", "source"], "run", "t", ["a", "b"])
    assert report.comparison_markdown(wide, "uid", "source", ["a", "b"]).collect()[0]["markdown"] == "> s\n- **a**: x\n- **b**: y"
    assert report.missing_links(spark.createDataFrame([("f", "x"), ("f", "y")], "file string, target string"), spark.createDataFrame([("f", "x")], "file string, anchor string")).count() == 1
    assert segments.chapters(spark.createDataFrame([(5, "a"), (7, "b"), (9, "c")], "d int, t string"), "d", "1,3").count() == 2


def make_archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>')
        z.writestr(
            "OEBPS/p.opf",
            '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>One</dc:title><dc:language>en</dc:language></metadata><manifest>'
            '<item id="n" href="nav.xhtml" properties="nav"/><item id="x" href="toc.ncx"/><item id="c1" href="c1.xhtml"/><item id="c2" href="gone.xhtml"/><item id="i" href="i.bin"/></manifest><spine><itemref idref="c2"/><itemref idref="c1"/></spine></package>',
        )
        z.writestr("OEBPS/nav.xhtml", "<html><body><nav><ol><li><a href='c1.xhtml'>One</a></li></ol></nav></body></html>")
        z.writestr("OEBPS/toc.ncx", '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><docTitle><text>T</text></docTitle><navMap><navPoint><navLabel><text>One</text></navLabel></navPoint></navMap></ncx>')
        z.writestr("OEBPS/c1.xhtml", "<html><head><title>x</title></head><body><h1>One</h1><p id='k'>Two <i>three</i><br/></p></body></html>")
        z.writestr("OEBPS/i.bin", b"\x00\x01")
    return out.getvalue()


def test_archives_there_and_back(spark, tmp_path):
    (tmp_path / "book.epub").write_bytes(make_archive())
    found = epub.read(spark, f"{tmp_path}/*.epub", "tr")
    book = epub.books(found).collect()[0]
    assert (book["title"], book["language"], book["creator"], book["ncx_path"]) == ("One", "en", None, "OEBPS/toc.ncx")
    assert [(r["doc_index"], r["href"], r["is_nav"]) for r in epub.documents(found).collect()] == [(1, "c1.xhtml", False), (2, "nav.xhtml", True)]
    segs = epub.segments(found)
    rows = {r["uid"]: r for r in segs.collect()}
    assert {u: (r["kind"], r["source"]) for u, r in rows.items()} == {"1:1": ("heading", "One"), "1:2": ("text", "Two <g1>three</g1><x2/>"), "2:1": ("text", "<g1>One</g1>"), "ncx:1": ("toc", "One")}
    assert rows["1:2"]["tagmap"][1]["tag"] == "i"
    translated = segs.withColumn("translation", F.when(F.col("uid") == "1:2", "<x2/>İki <g1>üç</g1>").when(F.col("uid") != "2:1", "Bir"))
    out = epub.rewrite_all(found, translated, "tr").collect()[0]
    assert (out["name"], out["applied"], out["lenient"], out["untranslated"]) == ("book.tr.epub", 2, 0, 1)
    new = zipfile.ZipFile(io.BytesIO(out["content"]))
    old = zipfile.ZipFile(io.BytesIO(make_archive()))
    assert new.namelist() == old.namelist() and new.infolist()[0].compress_type == zipfile.ZIP_STORED
    assert '<p id="k"><br/>İki <i>üç</i></p>' in new.read("OEBPS/c1.xhtml").decode()
    assert b"Bir" in new.read("OEBPS/toc.ncx") and b">tr<" in new.read("OEBPS/p.opf") and new.read("OEBPS/i.bin") == b"\x00\x01"
    both = epub.rewrite_all(found, translated, "tr", bilingual=True).collect()[0]
    text = zipfile.ZipFile(io.BytesIO(both["content"])).read("OEBPS/c1.xhtml").decode()
    assert both["name"] == "book.bilingual.tr.epub" and "One</h1><h1" in text and 'lang="tr"' in text
    assert [p.rsplit("/", 1)[1] for p in sinks.write_archives(epub.rewrite_all(found, translated, "tr"), f"{tmp_path}/out")] == ["book.tr.epub"]


def test_malformed_archive_text_is_read(spark):
    assert [s["plain"] for s in markup.segments(markup.parse("<body><p>One <b>two<p>three</i> & four &copy;</body>"))] == ["One two", "three & four ©"]


def test_pages(spark):
    html = "<html><head><title>x</title></head><body><nav><a href='u'>One &amp; two</a></nav><script>var t='</p>'</script><h2>Head</h2><p>A <b>b</b></p><p>12</p><li>c</li></body></html>"
    table = spark.createDataFrame([(1, "u", html), (2, None, None)], "page_id long, url string, html string")
    assert [(r["seg_no"], r["kind"], r["plain"]) for r in pages.segments(table).orderBy("seg_no").collect()] == [(1, "heading", "Head"), (2, "text", "A b"), (4, "text", "c")]
    assert [r["label"] for r in pages.nav_labels(table).collect()] == ["One & two"]


def test_streaming_resume(spark, three, tmp_path):
    def run():
        resume.start(spark, f"{tmp_path}/in", f"{tmp_path}/cache", f"{tmp_path}/out", f"{tmp_path}/check", ["upper"], "en", "tr", pause=False).awaitTermination()
        return {r["uid"]: r["translation"] for r in spark.read.parquet(*[str(p) for p in (tmp_path / "out").glob("batch=*")]).collect()}

    three.limit(2).write.parquet(f"{tmp_path}/in", mode="append")
    assert run() == {"0:1": "ONE", "0:2": "<g1>TWO</g1>"}
    three.where("doc_index = 1").write.parquet(f"{tmp_path}/in", mode="append")
    assert run() == {"0:1": "ONE", "0:2": "<g1>TWO</g1>", "1:1": "THREE"}
    assert run() == {"0:1": "ONE", "0:2": "<g1>TWO</g1>", "1:1": "THREE"}


def test_leftovers_are_asked_for_again(spark):
    from versomill.operators import leftover

    engines.register("dict", lambda: engines.Engine("dict", lambda t: [{"house rug": "ev halı", "the house": "ev."}.get(x, x) for x in t]))
    nodes = spark.createDataFrame([(0, 1, " Bu The House burada "), (0, 2, "tamam"), (0, 3, "kalan table")], "doc_index int, node int, text string")
    left = spark.createDataFrame([(0, 1, "The"), (0, 1, "House"), (0, 3, "table")], "doc_index int, node int, word string")
    fixed = leftover.retranslate(nodes, left, ["echo", "dict"])
    assert {r["node"]: (r["fixed"], r["words_left"]) for r in fixed.collect()} == {1: (" Bu Ev burada ", 0), 2: ("tamam", 0), 3: ("kalan table", 1)}
    assert tuple(leftover.totals(fixed).collect()[0]) == (3, 1, 1, 1)
    assert [(r["node"], r["words"]) for r in leftover.sample(fixed, left).collect()] == [(3, ["table"])]


def test_llm_requests_and_services():
    asked = []

    def complete(system, user):
        asked.append(user)
        return '<seg id="1">A</seg><seg id="7">z</seg>'

    assert engines.from_completion("llm", complete).translate(["a", "b"]) == ["A", "A"] and len(asked) == 2
    assert engines.ask_in_frames(lambda s, u: '<seg id="1">A</seg>', "", ["a", "b", "c", "d"]) == ["A", "A", "A", None]
    with pytest.raises(engines.EmptyOutput):
        engines.ask_in_frames(lambda s, u: "", "", ["a"])
    tried = []

    def by_model(model, system, user):
        tried.append(model)
        return "" if model == "m1" else "x"

    f = engines.with_models(["m1", "m2", "m3"], by_model)
    assert f("", "") == f("", "") == "x" and tried == ["m1", "m2", "m2"]
    r = random.Random(4)
    for _ in range(20):
        text = " ".join("".join(r.choice("aöçz.") for _ in range(r.randint(1, 40))) for _ in range(40)) + "ğ" * 300
        pieces = engines.split_bytes(text, 60)
        assert all(len(p.encode()) <= 60 for p in pieces) and "".join(pieces).replace(" ", "") == text.replace(" ", "")
    assert engines.bounded(str.upper, 10)(["aa bb cc dd ee"]) == ["AA BB CC DD EE"]
    assert engines.first_instance([lambda t: 1 / 0, lambda t: t, lambda t: t + "!"])(["a"]) == ["a!"]
    assert engines.setting({"a": ""}, "a", None, "b") == "b"


def test_candidates(spark):
    engines.register("tagless", lambda: engines.Engine("tagless", lambda t: [f"T {x}" for x in t], supports_tags=False))
    segs = spark.createDataFrame([("0:1", "One here. Two there.", "x"), ("0:2", "<g1>a</g1>", "y")], "uid string, source string, translation string")
    got = {(r["uid"], r["name"]): (r["text"], r["back"]) for r in quality.candidates(segs, ["tagless", "upper"], "echo").collect()}
    assert got == {
        ("0:1", "current"): ("x", "x"),
        ("0:1", "tagless"): ("T One here. Two there.", "T One here. Two there."),
        ("0:1", "tagless_sentences"): ("T One here. T Two there.", "T One here. T Two there."),
        ("0:1", "upper"): ("ONE HERE. TWO THERE.", "ONE HERE. TWO THERE."),
        ("0:2", "current"): ("y", "y"),
        ("0:2", "upper"): ("<g1>A</g1>", "A"),
    }


def test_glossary_for_a_book(spark):
    learned = spark.createDataFrame([("Della", "D"), ("Jim", "C"), ("Ann", "A")], "term string, target string")
    user = spark.createDataFrame([("Ann", "A")], "term string, target string")
    book = spark.createDataFrame([("della ran",)], "t string")
    assert {r["term"] for r in glossary.for_book(learned, user, book, "t").collect()} == {"Della", "Ann"}
    assert {r["term"]: r["target"] for r in glossary.merged(spark.createDataFrame([("Jim", "own")], "term string, target string"), learned).collect()} == {"Della": "D", "Jim": "own", "Ann": "A"}


def test_books_from_end_to_end(spark, tmp_path):
    from versomill.operators import book

    (tmp_path / "book.epub").write_bytes(make_archive())
    run = book.translate_books(spark, f"{tmp_path}/book.epub", ["upper"], "en", "tr", pause=False)
    assert {r["uid"]: r["translation"] for r in run["segments"].collect()} == {"1:1": "ONE", "1:2": "TWO <g1>THREE</g1><x2/>", "2:1": "<g1>ONE</g1>", "ncx:1": "ONE"}
    assert run["summary"].collect()[0]["exit_code"] == 0 and run["cache"].count() == 4
    data = zipfile.ZipFile(io.BytesIO(run["archives"].collect()[0]["content"]))
    assert b">ONE<" in data.read("OEBPS/p.opf") and "<h1>ONE</h1>" in data.read("OEBPS/c1.xhtml").decode()
    assert book.inspect(spark, f"{tmp_path}/book.epub").count() == 3
    assert [r["uid"] for r in book.selected(epub.segments(epub.read(spark, f"{tmp_path}/book.epub")), "1", 2).collect()] == ["ncx:1", "1:1"]

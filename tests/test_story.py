"""Runs of language models, mending, checking, adapters, and markup that must come back as it was."""

import io
import json
import re
import sys
import zipfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from versomill.operators import adapters, book, cache, engines, glossary, leftover, lexicon, markup, quality, story, textfix, translate
from versomill.sources import epub
from versomill.streaming import resume

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the engines made here travel to the workers

SEGMENTS = "book_id string, doc_index long, seg_no long, uid string, kind string, source string, plain string"


def rows_of(spark, *texts, doc=0):
    return spark.createDataFrame([("b", doc, k, f"{doc}:{k}", "text", t, re.sub("<[^>]*>", "", t)) for k, t in enumerate(texts, 1)], SEGMENTS)


def by_uid(df):
    return {r["uid"]: r["translation"] for r in df.collect()}


# --- markup ----------------------------------------------------------------------------------------------------------


def test_text_between_signs_is_kept():
    found = {1: ("g", ["b", {}, []])}
    children, ok = markup.decode("<g1>b</g1> 5 < 6 and 7 > 3 ok", found)
    assert ok and markup.serialise(["p", {}, children]) == "<p><b>b</b> 5 &lt; 6 and 7 &gt; 3 ok</p>"
    children, ok = markup.decode("a <i>b</i> <br/> <!x> < b > &lt;", {})
    assert "".join(children) == "a b  <!x> < b > <"


def test_placeholders_with_spaces():
    assert markup.problem("< g 1 >a< / g 1 >", {1: "g"}) is None
    assert markup.problem("<x1>", {1: "x"}) is None
    assert markup.problem("<g2>a</g2>", {1: "g"}) is not None


XHTML = """<?xml version="1.0" encoding="utf-8"?>
<!DOCTYPE html>
<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>t</title></head><body epub:type="bodymatter">
<!-- a note --><svg viewBox="0 0 1 1" preserveAspectRatio="none"><linearGradient id="g"></linearGradient></svg>
<p>One&nbsp;<i>two</i> &amp; three<?pi x?></p></body></html>
<!-- end -->"""


def test_xml_comes_back_as_it_was():
    assert markup.serialise(markup.parse(XHTML)) == XHTML.replace("&nbsp;", "\xa0")
    root = markup.parse(XHTML)
    entries = markup.segments(root)
    assert [e["source"] for e in entries] == ["One <g1>two</g1> &amp; three"]
    markup.apply(entries, {entries[0]["seg_no"]: "Bir <g1>iki</g1>"})
    out = markup.serialise(root)
    assert "<p>Bir <i>iki</i></p>" in out and 'viewBox="0 0 1 1"' in out and "linearGradient" in out and "<!-- a note -->" in out and out.startswith("<?xml") and out.endswith("<!-- end -->")
    assert markup.parse_xml("<p>a<br></p>") is None and markup.parse_xml("") is None
    assert markup.serialise(markup.parse("<p>a<br></p>")) == "<p>a<br/></p>"
    assert markup.serialise(markup.parse("<r/>")) == "<r></r>"
    assert "\u00e9" in markup.serialise(markup.parse('<?xml version="1.0" encoding="iso-8859-1"?><p>\u00e9</p>'))


# --- small rules -----------------------------------------------------------------------------------------------------


def test_names_at_the_start_of_a_text(spark):
    rows = spark.createDataFrame([(1, "\nAlpha runs."), (2, "\nAlpha runs."), (3, "So Beta- ran, and [Gamma] sat; so \u201cBeta\u201d ran, and [Gamma] sat")], "k int, t string")
    # the first word of a sentence is no evidence, and only the listed signs are stripped
    assert [(r["name"], r["n"]) for r in glossary.detect_names(rows, "t", "k").collect()] == [("Beta", 2)]


def test_target_share(spark):
    lex = spark.createDataFrame([("en", "house", 5.0), ("tr", "ev", 5.0), ("tr", "araba", 4.0), ("tr", "house", 3.0), ("tr", "nadir", 2.0)], "lang string, word string, zipf double")
    rows = spark.createDataFrame([(1, "Della araba house nadir \u0131rmak to"), (2, ""), (3, None)], "k int, t string")
    # a capital, a frequent word, a letter of its own and a short word are fine; a source word and a rare word are not
    assert {r["k"]: round(r["share"], 4) for r in quality.target_share(rows, lex, "t", "en", "tr", "k").collect()} == {1: round(4 / 6, 4), 2: 1.0, 3: 1.0}


def test_frequencies_of_hot_and_rare_words(spark, monkeypatch):
    lex = spark.createDataFrame([("en", "the", 7.0), ("en", "rug", 3.0), ("tr", "rug", 1.0)], "lang string, word string, zipf double")
    tokens = spark.createDataFrame([(k, w) for k, w in enumerate(["The", "the", "rug", "none", None])], "k int, word string")
    want = {0: (7.0, 0.0), 1: (7.0, 0.0), 2: (3.0, 1.0), 3: (0.0, 0.0), 4: (0.0, 0.0)}
    for hot in (4096, 1):
        monkeypatch.setattr(lexicon, "HOT_WORDS", hot)
        assert {r["k"]: (r["s"], r["t"]) for r in lexicon.with_frequencies(tokens, lex, "en", "tr").collect()} == want


def test_terms_in_texts(spark, monkeypatch):
    terms = spark.createDataFrame([("ab",), ("b",), ("",), (None,), ("ab",), ("xyz",)], "t string")
    texts = spark.createDataFrame([(1, "cab"), (2, "zz"), (3, None), (4, "xyzb")], "k int, x string")
    for size in (100, 1):
        monkeypatch.setattr(glossary, "TERMS_AT_ONCE", size)
        got = glossary.in_text(terms, texts, "t", "x").collect()
        assert sorted((r["k"], r["t"]) for r in got) == [(1, "ab"), (1, "b"), (4, "b"), (4, "xyz")]


def test_stretched_words(spark):
    lex = spark.createDataFrame([("en", w, z) for w, z in (("so", 6.0), ("no", 6.0), ("penny", 4.0), ("pennyworth", 2.0), ("terrible", 4.5), ("trouble", 5.0), ("blue", 5.0), ("grey", 4.5))], "lang string, word string, zipf double")
    words = spark.createDataFrame([("d", w) for w in ("So\u2014o\u2014o", "blue\u2014grey", "I\u2014I", "NO\u2014O", "ter\u2014r\u2014ble", "zzz\u2014zzq")], "doc string, word string")
    got = {r["word"]: r["fixed"] for r in lexicon.unstretched(words, lex, "en", "word", spark.createDataFrame([("d", "terrible")], "doc string, word string"), "doc").collect()}
    assert got == {"So\u2014o\u2014o": "So", "blue\u2014grey": "blue\u2014grey", "I\u2014I": "I\u2014I", "NO\u2014O": "NO", "ter\u2014r\u2014ble": "terrible", "zzz\u2014zzq": "zzz\u2014zzq"}


def test_left_over_runs_keep_their_case():
    e = engines.Engine("tr", lambda t: [{"the landing": "iskele.", "rug": "iki"}.get(x, x) for x in t])
    assert leftover.improve("X THE LANDING y", {"THE", "LANDING"}, [e], "tr") == ("X İSKELE y", 0)
    assert leftover.improve("Rug kald\u0131", {"Rug"}, [e], "tr") == ("İki kald\u0131", 0)


# --- engines ---------------------------------------------------------------------------------------------------------


def test_each_engine_gets_what_it_can_read():
    seen = {}

    def engine(name, tags):
        return engines.Engine(name, lambda t: seen.setdefault(name, t) and [None] * len(t), supports_tags=tags)

    engines.through_chain([engine("a", True), engine("b", False), engine("c", True)], ["<g1>x</g1>"], 1, plain=["x"])
    assert seen == {"a": ["<g1>x</g1>"], "b": ["x"], "c": ["<g1>x</g1>"]}


class Net:
    """Answers in order; remembers requests."""

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def __call__(self, method, url, **more):
        self.asked.append((method, url, more))
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return adapters.Answer(a[0], a[1] if isinstance(a[1], str) else json.dumps(a[1]))


def test_google():
    net = Net((200, [["a&#39;b", "en"]]), (200, ["x", "y"]))
    e = adapters.google(send=net)
    long = "z" * 4400
    assert e.translate([long, "p" * 200, "q"]) == ["a'b", "x", "y"]
    assert [len(m["form"]) for _, _, m in net.asked] == [1, 2] and net.asked[0][2]["params"]["tl"] == "tr"
    assert adapters.google(send=Net((429, "")), deep=str.upper).translate(["a"]) == ["A"]
    with pytest.raises(engines.EngineError):
        adapters.google(send=Net((500, "")), deep=lambda t: 1 / 0).translate(["a"])
    with pytest.raises(engines.EngineError):
        adapters.google(send=Net((200, ["x"]))).translate(["a", "b"])


def test_package():
    asked = []
    e = adapters.package("Bing", client=lambda t, **k: asked.append(k) or t.upper())
    assert (e.name, e.max_chars, e.translate(["a"])) == ("bing", 1000, ["A"]) and asked[0]["translator"] == "Bing"

    def limited(t, **k):
        raise RuntimeError("HTTP 429")

    with pytest.raises(engines.RateLimited):
        adapters.package("bing", client=limited).translate(["a"])
    with pytest.raises(engines.EngineError):
        adapters.package("bing", client=lambda t, **k: "").translate(["a"])


def test_mymemory(monkeypatch):
    monkeypatch.setenv("MYMEMORY_EMAIL", "a@b.org")
    ok = {"responseData": {"translatedText": "x &amp; y"}, "responseStatus": 200}
    net = Net((200, ok), (200, ok), (200, ok))
    assert adapters.mymemory(send=net).translate(["a", "b " * 400]) == ["x & y", "x & y x & y"]
    assert net.asked[0][2]["params"]["de"] == "a@b.org" and all(len(m["params"]["q"].encode()) <= 480 for _, _, m in net.asked)
    with pytest.raises(engines.RateLimited):
        adapters.mymemory(send=Net((200, {"responseData": {"translatedText": "MYMEMORY WARNING: no"}, "responseStatus": 429}))).translate(["a"])
    with pytest.raises(engines.EngineError):
        adapters.mymemory(send=Net((200, {"responseStatus": 403, "responseDetails": "no"}))).translate(["a"])


def test_lingva(monkeypatch):
    monkeypatch.delenv("LINGVA_URL", raising=False)
    net = Net(engines.EngineError("down"), (200, {"translation": "a b"}), (200, {"translation": "c"}))
    assert adapters.lingva(send=net).translate(["a b"]) == ["c"] and net.asked[0][1].endswith("/api/v1/en/tr/a%20b")
    with pytest.raises(engines.EngineError):
        adapters.lingva(send=Net((200, {"translation": "a"}), (500, ""), (200, {}))).translate(["a"])


def test_libretranslate(monkeypatch):
    monkeypatch.setenv("LIBRETRANSLATE_API_KEY", "k")
    net = Net((200, {"translatedText": "x"}))
    assert adapters.libretranslate(send=net).translate(["a"]) == ["x"] and net.asked[0][2]["payload"]["api_key"] == "k"
    with pytest.raises(engines.RateLimited):
        adapters.libretranslate(send=Net((429, ""))).translate(["a"])
    with pytest.raises(engines.EngineUnavailable):
        adapters.libretranslate(send=Net(engines.EngineError("down"))).check()


def test_argos():
    class Lang:
        def __init__(self, code):
            self.code = code

        def get_translation(self, other):
            return None

    class Package:
        from_code, to_code = "en", "tr"

        def download(self):
            return "file"

    class Translator:
        get_installed_languages = staticmethod(lambda: [Lang("en"), Lang("tr")])
        translate = staticmethod(lambda t, a, b: f"{a}{b} {t}")

    class Store:
        installed = []
        update_package_index = staticmethod(lambda: None)
        get_available_packages = staticmethod(lambda: [Package()])
        install_from_path = staticmethod(lambda p: Store.installed.append(p))

    e = adapters.argos(modules=(Translator, Store))
    assert e.translate(["a", "b"]) == ["entr a", "entr b"] and Store.installed == ["file"] and not e.supports_tags
    with pytest.raises(engines.EngineUnavailable):
        adapters.argos("en", "xx", modules=(Translator, Store)).check()


def test_local_and_chat_services(monkeypatch):
    net = Net((200, {"models": [{"name": "m:latest"}]}), (200, {"message": {"content": '<seg id="1">x</seg>'}}))
    e = adapters.ollama("m", net)
    e.check()
    assert e.translate(["a"]) == ["x"] and net.asked[1][2]["payload"]["options"]["num_predict"] >= 512
    with pytest.raises(engines.EngineUnavailable):
        adapters.ollama("other", Net((200, {"models": []}))).check()
    monkeypatch.delenv("GROQ_API_KEY", raising=False)
    with pytest.raises(engines.EngineUnavailable):
        adapters.chat("groq").check()
    monkeypatch.setenv("GROQ_API_KEY", "k")
    net = Net((200, {"choices": [{"message": {"content": "hi"}}]}), (429, ""), (500, "no"))
    e = adapters.chat("groq", send=net)
    assert e.complete("s", "u") == "hi" and net.asked[0][2]["headers"] == {"Authorization": "Bearer k"} and e.is_llm
    with pytest.raises(engines.RateLimited):
        e.complete("s", "u")
    with pytest.raises(engines.EngineError):
        e.complete("s", "u")


def test_command_line_models(tmp_path):
    said = {
        "one": (0, "", "Rate limit exceeded\n"),
        "two": (1, '{"type":"error","error":"x"}', ""),
        "three": (0, '{"type":"text","part":{"text":"a"}}\n{"type":"text","part":{"text":"b"}}', ""),
    }
    asked = []

    def run(command, folder, timeout, stop):
        asked.append(command[command.index("-m") + 1])
        assert stop("Too Many Requests") and not stop("fine")
        return said[asked[-1]]

    e = adapters.opencode(["one", "two", "three"], run, "/bin/true", str(tmp_path))
    e.check()
    assert e.complete("system", "user") == "ab" and e.complete("system", "user") == "ab" and asked == ["one", "two", "three", "three"]
    assert len(list(tmp_path.iterdir())) == 1
    with pytest.raises(engines.EngineError):
        adapters.opencode(["one", "two"], run, "/bin/true", str(tmp_path)).complete("system", "user")
    with pytest.raises(engines.EngineUnavailable):
        adapters.opencode(["one"], run, "/no/such/file").check()
    assert adapters.events_text("plain \x1b[31mtext")[0] == "plain text"


def test_a_process_is_ended_at_its_limit(tmp_path):
    code, out, errors = adapters.process(["sh", "-c", "echo out; echo quota >&2; sleep 30"], str(tmp_path), 20, lambda line: "quota" in line)
    assert code != 0 and "quota" in errors
    with pytest.raises(engines.EngineError):
        adapters.process(["sleep", "30"], str(tmp_path), 0.2, lambda line: False)


# --- stories ---------------------------------------------------------------------------------------------------------

SEG = re.compile(r'<seg id="(\d+)">(.*?)</seg>', re.S)


def model(name, answer, register=True, **more):
    """A language model whose answers are made from (system, user); it remembers what it was asked in a list."""
    asked = []

    def complete(system, user):
        asked.append((system, user))
        return answer(system, user, len(asked))

    e = engines.from_completion(name, complete)
    e.model = more.get("model")
    if register:
        engines.register(name, lambda: e)
    return e, asked


def upper(system, user, n):
    found = SEG.findall(user.rsplit("Draft (", 1)[-1])
    return "\n".join(f'<seg id="{k}">{"".join(p if p.startswith("<") else p.upper() for p in re.split("(<[^>]*>)", t))}</seg>' for k, t in found)


def document(settings, chain, rows, names=(), known=None, polisher=None):
    d = story.Document(settings, chain, polisher, list(names), known or {})
    done = d.run([{"source": t, "plain": re.sub("<[^>]*>", "", t), "cached": None, "result": None, "engine": None, "hit": False} for t in rows])
    return d, [(r["result"], r["engine"]) for r in done]


def test_context_glossary_and_names_reach_the_prompts():
    def answer(system, user, n):
        return upper(system, user, n) + ("\n<glossary>\nDella => Dela\n- Nobody => x\nrug => hal\u0131\n" if n == 1 else "")

    e, asked = model("m", answer, False)
    d, done = document(story.Settings(chunk_chars=20, context=1, pause=False), [e], ["Della had a rug.", "Jim sat there too.", "Della ran away now."], ["Jim", "Ann"], {"Jim": "Cim"})
    assert [r for r, _ in done] == ["DELLA HAD A RUG.", "JIM SAT THERE TOO.", "DELLA RAN AWAY NOW."]
    assert d.new_terms == [(1, 0, "Della", "Dela"), (1, 1, "rug", "hal\u0131")]  # what the chunk does not have is not learned
    assert "Context" not in asked[0][1] and "Della had a rug. => DELLA HAD A RUG." in asked[1][1] and "Della had a rug." not in asked[2][1]
    assert "Della => Dela" in asked[1][1] and "Names:" not in asked[1][1]  # Jim is in the glossary
    assert "English into Turkish" in asked[0][0] or "from English" in asked[0][0]


def test_what_an_answer_leaves_out_is_asked_for_again():
    def answer(system, user, n):
        return "\n".join(x for x in upper(system, user, n).split("\n")[:1])

    e, asked = model("m", answer, False)
    _, done = document(story.Settings(pause=False), [e, engines.make("echo")], ["a", "b", "c", "d"])
    assert done == [("A", "m"), ("B", "m"), ("C", "m"), ("d", "echo")] and len(asked) == 3


def test_a_model_that_fails_makes_room_for_the_next():
    e, asked = model("m", lambda s, u, n: "nothing of use", False)
    d, done = document(story.Settings(retries=2, pause=False), [e, engines.make("upper")], ["<g1>a</g1>"])
    assert done == [("<g1>A</g1>", "upper")] and len(asked) == 2
    assert [(r["engine"], r["ok"]) for r in d.log] == [("m", False), ("m", False), ("upper", True)]


def test_polish_keeps_drafts_that_it_would_break():
    def polish(system, user, n):
        return '<seg id="1">better</seg>\n<seg id="2">lost its tags</seg>'

    e, _ = model("m", upper, False)
    p, asked = model("p", polish, False)
    d, done = document(story.Settings(polish=True, pause=False), [e], ["a", "<g1>b</g1> c"], polisher=p)
    assert [r for r, _ in done] == ["better", "<g1>B</g1> C"] and d.polished == 1
    assert "Draft (Turkish)" in asked[0][1] and "You revise" in asked[0][0]
    failing, _ = model("f", lambda s, u, n: 1 / 0, False)
    _, done = document(story.Settings(polish=True, retries=1, pause=False), [e], ["a"], polisher=failing)
    assert done == [("A", "m")]


def test_budget_of_the_context():
    assert story.context_for([("a" * 10, "b" * 10), ("c" * 3, "d" * 3)], 8) == [("aa", "bb"), ("ccc", "ddd")]
    assert story.context_for([("a", "b")], 0) == []


def test_prompts_are_the_same_as_columns(spark):
    g, names, ctx, texts = {"a": "b"}, ["Jim"], [("s", "t")], ["x", "y"]
    row = spark.range(1).select(
        glossary.user_prompt(F.create_map(F.lit("a"), F.lit("b")), F.array(F.lit("Jim")), F.array(F.lit("s")), F.array(F.lit("t")), F.lit("en"), F.lit("tr"), F.array(F.lit(1), F.lit(2)), F.array(F.lit("x"), F.lit("y"))).alias("u"),
        glossary.system_prompt(F.lit("en"), F.lit("tr"), F.lit("dash")).alias("s"),
    ).collect()[0]
    assert row["u"] == story.user_prompt(g, names, ctx, "en", "tr", texts) and row["s"] == story.system_prompt("en", "tr", "dash")
    from versomill.functions import text as X

    cases = [("<g1>A</g1>", "A", "b"), ("<g1>A <x2/></g1>", "A", "b"), ("A", "A", '"b"'), ('"A"', '"A"', '"b"'), ("<g1>A</g1>", "A", "<g1>b</g1>"), ("A", "A", ""), ("A", "A", "\u201cb\u201d and \u201cc\u201d")]
    got = spark.createDataFrame(cases, "s string, p string, r string").select(X.rewrap(F.col("s"), F.col("p"), F.col("r")).alias("x")).collect()
    assert [r["x"] for r in got] == [story.rewrapped(*c) for c in cases]


def test_story_over_books(spark):
    model("teller", lambda s, u, n: upper(s, u, n) + ("\n<glossary>Della => Dela</glossary>" if "Della" in u else ""))
    rows = rows_of(spark, "So Della ran and Della sat.", "Then <g1>she</g1> left.").unionByName(rows_of(spark, "Another one.", doc=1))
    facts = story.book_facts(rows, spark.createDataFrame([("left", "gitti")], "term string, target string"), spark.createDataFrame([("b", "ANOTHER", "ba\u015fka"), ("b", "absent", "x"), ("c", "ran", "y")], cache.GLOSSARY_SCHEMA))
    f = facts.collect()[0]
    assert f["names"] == ["Della"] and json.loads(f["glossary"]) == {"ANOTHER": "ba\u015fka", "left": "gitti"}
    done = story.translate(rows, facts, ["teller"], None, story.Settings(pause=False)).cache()
    assert {(r["doc_index"], r["seg_no"]): (r["translation"], r["engine"]) for r in done.collect()} == {(0, 1): ("SO DELLA RAN AND DELLA SAT.", "teller"), (0, 2): ("THEN <g1>SHE</g1> LEFT.", "teller"), (1, 1): ("ANOTHER ONE.", "teller")}
    assert [tuple(r) for r in story.glossary_rows(done).collect()] == [("b", "Della", "Dela")]
    assert {tuple(r) for r in story.glossary_rows(done, spark.createDataFrame([("b", "Della", "old")], cache.GLOSSARY_SCHEMA)).collect()} == {("b", "Della", "old")}
    assert story.calls(done).count() == 2
    joined = rows.join(done.drop("facts"), ["book_id", "doc_index", "seg_no"])
    kept = translate.cache_rows(joined, ["teller"], "en", "tr")
    again = story.translate(rows, facts, ["teller"], kept, story.Settings(pause=False))
    assert again.where("hit").count() == 3 and story.calls(again).count() == 0
    # a chunk that the cache has in part goes to the engine as a whole
    part = story.translate(rows, facts, ["teller"], kept.where("source like 'So%'"), story.Settings(pause=False))
    assert part.where("hit").count() == 0


def make_book(body, broken=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
        z.writestr("p.opf", '<package><metadata><title>One</title><language>en</language></metadata><manifest><item id="c" href="c.xhtml"/></manifest><spine><itemref idref="c"/></spine>' + ("" if broken else "</package>"))
        z.writestr("c.xhtml", f"<html><head><title>x</title></head><body>{body}</body></html>")
    return out.getvalue()


LEX = [("en", "so", 6.0), ("en", "penny", 4.0), ("en", "pennyworth", 2.0), ("en", "two", 6.0), ("en", "carpet", 4.5), ("en", "said", 6.0), ("tr", "hal\u0131", 4.0)]


def test_books_by_a_language_model(spark, tmp_path):
    model("teller", lambda s, u, n: upper(s, u, n) + "\n<glossary>One => Bir</glossary>", model="m1")
    (tmp_path / "book.epub").write_bytes(make_book("<h1>One</h1><p>He said so\u2014o\u2014o, two p<br/>ennyworth.</p>"))
    lex = spark.createDataFrame(LEX, "lang string, word string, zipf double")
    run = book.translate_books(spark, f"{tmp_path}/book.epub", ["teller"], "en", "tr", pause=False, lexicon=lex, folder=f"{tmp_path}/run")
    assert by_uid(run["segments"]) == {"0:1": "ONE", "0:2": "HE SAID SO, TWO PENNYWORTH."}
    assert [tuple(r)[1:] for r in run["glossary"].collect()] == [("One", "Bir")]
    r = run["report"]
    assert (r["segments"], r["translated"], r["selected_missing"], r["engine_calls"], r["engine_models"], r["glossary_size"], r["engine_segments"], r["errors"]) == (2, 2, 0, {"teller": 1}, {"teller": "m1"}, 1, {"teller": 2}, [])
    assert set(r) == {"output", "quality", "qa", "seconds", "segments", "chars", "translated", "untranslated", "selected_missing", "markup_fallbacks", "engine_segments", "engine_models", "engine_calls", "failures", "polished_segments", "cache_hits", "glossary_size", "errors"}
    rows = run["cache"].collect()
    assert {x["stage"] for x in rows} == {"llm"}
    kept = spark.createDataFrame(rows, cache.SCHEMA)
    path = f"{tmp_path}/glossary"
    cache.write(cache.merged_glossary(cache.read_glossary(spark, path), run["glossary"]), path)
    known = cache.read_glossary(spark, path)
    assert cache.read_glossary(spark, path, known.collect()[0]["book"]).count() == 1 and cache.read_glossary(spark, path, "other").count() == 0
    again = book.translate_books(spark, f"{tmp_path}/book.epub", ["teller"], "en", "tr", kept, pause=False, lexicon=lex, glossary=known, folder=f"{tmp_path}/again")
    assert again["report"]["cache_hits"] == 2 and again["report"]["engine_calls"] == {} and again["report"]["glossary_size"] == 1


def test_better_and_checked_books(spark, tmp_path):
    good = {"A carpet lay there on the floor of the house.": "Evin zemininde bir hal\u0131 duruyordu, \u00e7ok g\u00fczel.", "One": "Bir", "carpet": "hal\u0131"}
    back = {v: k for k, v in good.items()}
    engines.register("bad", lambda src="en", tgt="tr": engines.Engine("bad", lambda t: [back.get(x, "A carpet") if src == "tr" else "carpet" if len(x) > 20 else good.get(x, x) for x in t]), True)
    engines.register("good", lambda src="en", tgt="tr": engines.Engine("good", lambda t: [good.get(x, x) for x in t]), True)
    (tmp_path / "book.epub").write_bytes(make_book("<h1>One</h1><p>A carpet lay there on the floor of the house.</p>"))
    lex = spark.createDataFrame(LEX, "lang string, word string, zipf double")
    run = book.translate_books(spark, f"{tmp_path}/book.epub", ["bad", "good"], "en", "tr", pause=False, lexicon=lex, better=True, folder=f"{tmp_path}/run")
    assert by_uid(run["segments"])["0:2"] == good["A carpet lay there on the floor of the house."]
    assert run["report"]["quality"] == {"checked": 2, "flagged": 1, "replaced": 1}
    # the cache gives the better text to the next run
    assert {r["source"]: r["result"] for r in run["cache"].where("engine = 'bad'").collect()}["A carpet lay there on the floor of the house."].startswith("Evin")
    run = book.translate_books(spark, f"{tmp_path}/book.epub", ["bad"], "en", "tr", pause=False, lexicon=lex, check=True, folder=f"{tmp_path}/check")
    text = zipfile.ZipFile(io.BytesIO(run["archives"].collect()[0]["content"])).read("c.xhtml").decode()
    assert "<p>hal\u0131</p>" in text and run["report"]["qa"]["nodes_fixed"] == 1 and run["report"]["qa"]["words_left"] == 0


def test_packages_that_are_not_well_formed(spark, tmp_path):
    (tmp_path / "broken.epub").write_bytes(make_book("<p>One.</p>", broken=True))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
    (tmp_path / "empty.epub").write_bytes(out.getvalue())
    found = epub.read(spark, f"{tmp_path}/*.epub", "tr")
    assert [r["plain"] for r in epub.segments(found).collect()] == ["One."]
    made = {r["name"]: r["content"] for r in epub.rewrite_all(found, epub.segments(found).withColumn("translation", F.lit("Bir.")), "tr").collect()}
    assert "<p>Bir.</p>" in zipfile.ZipFile(io.BytesIO(made["broken.tr.epub"])).read("c.xhtml").decode() and "empty.tr.epub" in made


def test_mending_needs_a_lexicon_and_a_language(spark, tmp_path):
    (tmp_path / "book.epub").write_bytes(make_book("<p>so\u2014o\u2014o</p>"))
    found = epub.read(spark, f"{tmp_path}/book.epub")
    lex = spark.createDataFrame(LEX, "lang string, word string, zipf double")
    assert textfix.mended(found, None, "en").collect()[0]["fixes"] is None
    assert textfix.mended(found, lex, "de").collect()[0]["fixes"] is None
    assert json.loads(textfix.mended(found, lex, "en").collect()[0]["fixes"]) == {"0": {"words": {"so\u2014o\u2014o": "so"}, "joined": []}}


def test_resume_keeps_results_of_any_engine(spark, tmp_path):
    """A language model first, whose results have a stage of their own, and a fallback for what it leaves out."""
    model("picky", lambda s, u, n: "".join(x for x in upper(s, u, n).split("\n") if "ONE" in x) or "nothing")
    rows = [(0, 1, "0:1", "text", "One", "One"), (1, 1, "1:1", "text", "Two", "Two")]
    spark.createDataFrame(rows, resume.SEGMENTS).write.parquet(f"{tmp_path}/in")
    resume.start(spark, f"{tmp_path}/in", f"{tmp_path}/cache", f"{tmp_path}/out", f"{tmp_path}/check", ["picky", "echo"], "en", "tr", pause=False, retries=1).awaitTermination()
    out = spark.read.parquet(*[str(p) for p in (tmp_path / "out").glob("batch=*")])
    assert {r["uid"]: (r["translation"], r["engine"]) for r in out.collect()} == {"0:1": ("ONE", "picky"), "1:1": ("Two", "echo")}
    kept = spark.read.parquet(*[str(p) for p in (tmp_path / "cache").glob("batch=*")])
    assert {(r["engine"], r["stage"]) for r in kept.collect()} == {("picky", "llm"), ("echo", "mt")}

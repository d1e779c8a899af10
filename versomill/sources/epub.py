"""EPUB archives as tables of books, documents and segments, and back.

Archives are read with ``binaryFile`` and opened on the executors; a book is one row,
so a run over many books is as parallel as there are books.
"""

from __future__ import annotations

import io
import json
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_id
from ..operators import markup

BOOK_SCHEMA = "book_id string, path string, title string, language string, creator string, opf_path string, ncx_path string"
DOCUMENT_SCHEMA = "book_id string, doc_index int, zip_path string, href string, is_nav boolean, markup string"
SEGMENT_SCHEMA = "book_id string, doc_index int, seg_no int, uid string, kind string, source string, plain string, tagmap map<int, struct<kind: string, tag: string, attrs: map<string, string>>>, translation string, engine string"


def _children(node, name: str):
    return [x for x in node.iter() if markup.local(x.tag) == name.lower()]


def _tolerant(raw: bytes) -> ET.Element:
    """The elements of what may not be well formed, by local names."""
    try:
        return ET.fromstring(raw)
    except ET.ParseError:
        pass

    def made(node):
        e = ET.Element(markup.local(node[0]) or "root", {k: v for k, v in node[1].items()})
        for c in node[2]:
            if isinstance(c, str):
                if len(e):
                    e[-1].tail = (e[-1].tail or "") + c
                else:
                    e.text = (e.text or "") + c
            elif c[0] != markup.RAW:
                e.append(made(c))
        return e

    return made(markup.parse(raw.decode("utf-8", "replace").replace("/>", "></x>")))


class Archive:
    """One archive: its package, metadata and documents in reading order.

    A container or package that is not well formed is read tolerantly; without a
    container the first package is taken, without a package there are no documents.
    """

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.zip.namelist())
        roots = _children(_tolerant(self.zip.read("META-INF/container.xml")), "rootfile") if "META-INF/container.xml" in names else []
        paths = [r.attrib["full-path"] for r in roots if r.attrib.get("full-path") in names]
        self.opf_path = next(iter(paths or sorted(n for n in names if n.endswith(".opf"))), None)
        self.folder = posixpath.dirname(self.opf_path or "")
        self.opf = _tolerant(self.zip.read(self.opf_path)) if self.opf_path else ET.Element("package")
        self.title, self.language, self.creator = (next((x.text for x in _children(self.opf, n) if x.text), None) for n in ("title", "language", "creator"))
        items = {x.attrib["id"]: x.attrib for x in _children(self.opf, "item") if "id" in x.attrib and "href" in x.attrib}
        order = [x.attrib["idref"] for x in _children(self.opf, "itemref") if "idref" in x.attrib]
        navs = [k for k, a in items.items() if "nav" in a.get("properties", "").split()]
        self.ncx_path = next((self.at(a["href"]) for a in items.values() if a["href"].endswith(".ncx")), None)
        if self.ncx_path not in names:
            self.ncx_path = None
        self.documents: list[tuple[int, str, str, bool]] = []
        for k, key in enumerate([*order, *(n for n in navs if n not in order)]):
            href = items.get(key, {}).get("href")
            if href and not href.endswith(".ncx") and self.at(href) in names:  # gaps in numbers are normal
                self.documents.append((k, self.at(href), href, key in navs))

    def at(self, href: str) -> str:
        return posixpath.normpath(posixpath.join(self.folder, href))

    def text(self, path: str) -> str:
        return self.zip.read(path).decode("utf-8", "replace")

    def labels(self) -> list[tuple[int, str]]:
        """Labels of the NCX from 1; the book's title is none."""
        if self.ncx_path is None:
            return []
        try:
            root = ET.fromstring(self.zip.read(self.ncx_path))
        except ET.ParseError:
            return []
        texts = [t.text or "" for label in _children(root, "navLabel") for t in _children(label, "text")]
        return [(k, t.strip()) for k, t in enumerate(texts, 1) if t.strip()]


def _each(df: DataFrame, one, schema: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for pdf in frames:
            rows = [r for k, content, path in zip(pdf["book_id"], pdf["content"], pdf["path"]) for r in one(k, content, path)]
            yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, schema)


def read(spark: SparkSession, paths: str | list[str], target: str = "") -> DataFrame:
    """book_id, path and content of every archive."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(file_id(F.col("content"), F.lit(target)).alias("book_id"), "path", "content")


def books(archives: DataFrame) -> DataFrame:
    def one(book_id, content, path):
        a = Archive(content)
        yield {"book_id": book_id, "path": path, "title": a.title, "language": a.language, "creator": a.creator, "opf_path": a.opf_path, "ncx_path": a.ncx_path}

    return _each(archives, one, BOOK_SCHEMA)


def documents(archives: DataFrame) -> DataFrame:
    def one(book_id, content, path):
        a = Archive(content)
        for k, zip_path, href, nav in a.documents:
            yield {"book_id": book_id, "doc_index": k, "zip_path": zip_path, "href": href, "is_nav": nav, "markup": a.text(zip_path)}

    return _each(archives, one, DOCUMENT_SCHEMA)


def _prepared(text: str, translate_pre: bool = True, strip: bool = False, fixes: dict | None = None) -> list:
    """A document's tree, mended in this order: boilerplate, prose in pre, words."""
    root = markup.parse(text)
    if strip:
        markup.strip_boilerplate(root)
    if translate_pre:
        markup.prose_pre(root)
    if fixes:
        markup.fix_words(root, fixes.get("words", {}), {tuple(x) for x in fixes.get("joined", [])})
    return root


def _fixes_of(value) -> dict:
    return json.loads(value) if isinstance(value, str) else {}


def segments(archives: DataFrame, keep_boilerplate: bool = False, translate_toc: bool = True, translate_pre: bool = True, strip_boilerplate: bool = False) -> DataFrame:
    """All segments: content in reading order, navigation, and NCX labels under doc_index -1.

    Archives may have ``fixes``: each document's mended words, as JSON by doc_index.
    """

    def one(book_id, content, fixes):
        a = Archive(content)
        base = {"book_id": book_id, "translation": None, "engine": None}
        for k, zip_path, _, nav in a.documents:
            if nav and not translate_toc:
                continue
            for s in markup.segments(_prepared(a.text(zip_path), translate_pre, strip_boilerplate, fixes.get(str(k))), nav, keep_boilerplate):
                tags = {n: {"kind": kind, "tag": e[0], "attrs": e[1]} for n, (kind, e) in s["found"].items()}
                yield base | {"doc_index": k, "seg_no": s["seg_no"], "uid": f"{k}:{s['seg_no']}", "kind": s["kind"], "source": s["source"], "plain": s["plain"], "tagmap": tags}
        if translate_toc:
            for n, label in a.labels():
                yield base | {"doc_index": -1, "seg_no": n, "uid": f"ncx:{n}", "kind": "toc", "source": markup.escape(label), "plain": label, "tagmap": {}}

    def run(frames):
        for pdf in frames:
            rows = [r for k, content, fixes in zip(pdf["book_id"], pdf["content"], pdf["fixes"]) for r in one(k, content, _fixes_of(fixes))]
            yield pd.DataFrame(rows, columns=["book_id", "doc_index", "seg_no", "uid", "kind", "source", "plain", "tagmap", "translation", "engine"])

    return _with_fixes(archives).select("book_id", "content", "fixes").mapInPandas(run, SEGMENT_SCHEMA)


def _with_fixes(archives: DataFrame) -> DataFrame:
    return archives if "fixes" in archives.columns else archives.withColumn("fixes", F.lit(None).cast("string"))


def suspects(archives: DataFrame) -> DataFrame:
    """book_id, doc_index, kind (stretched, break or word), a and b of what may have to be mended in content documents."""

    def one(book_id, content, path):
        a = Archive(content)
        for k, zip_path, _, nav in a.documents:
            if not nav:
                stretched, pairs, every = markup.word_suspects(_prepared(a.text(zip_path)))
                found = [("stretched", w, None) for w in sorted(stretched)] + [("break", x, y) for x, y in sorted(pairs)]
                if stretched:
                    found += [("word", w, None) for w in sorted(every)]
                for kind, x, y in found:
                    yield {"book_id": book_id, "doc_index": k, "kind": kind, "a": x, "b": y}

    return _each(archives, one, "book_id string, doc_index int, kind string, a string, b string")


def text_nodes(translated: DataFrame) -> DataFrame:
    """book_id, entry, node and text of every text of translated archives' documents; navigation is left out."""

    def one(book_id, content, path):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in z.namelist():
                if (raw := _checked(name, z)) is not None:
                    for n, (at, k) in enumerate(markup.text_nodes(markup.parse(raw))):
                        yield {"book_id": book_id, "entry": name, "node": n, "text": at[k]}

    return _each(translated.select("book_id", "content", F.col("name").alias("path")), one, "book_id string, entry string, node int, text string")


def _checked(name: str, z: zipfile.ZipFile) -> str | None:
    """The text of an entry that a check for left-over words looks at."""
    if not name.lower().endswith((".xhtml", ".html", ".htm")):
        return None
    text = z.read(name).decode("utf-8", "replace")
    return None if "<nav" in text else text


def with_texts(translated: DataFrame, fixed: DataFrame) -> DataFrame:
    """Translated archives with the fixed texts (book_id, entry, node, fixed) put in; every other entry stays as it is."""
    maps = fixed.groupBy("book_id").agg(F.to_json(F.collect_list(F.struct("entry", "node", "fixed"))).alias("texts"))
    rows = translated.join(maps, "book_id", "left")
    names = translated.columns

    def run(frames):
        for pdf in frames:
            done = []
            for content, texts in zip(pdf["content"], pdf["texts"]):
                by_entry: dict[str, dict[int, str]] = {}
                for x in json.loads(texts) if isinstance(texts, str) else []:
                    by_entry.setdefault(x["entry"], {})[x["node"]] = x["fixed"]
                new = {}
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name, own in by_entry.items():
                        root = markup.parse(z.read(name).decode("utf-8", "replace"))
                        for n, (at, k) in enumerate(markup.text_nodes(root)):
                            at[k] = own.get(n, at[k])
                        new[name] = markup.serialise(root).encode()
                    done.append(_zipped(z, new) if new else content)
            yield pdf.drop(columns="texts").assign(content=done)[names]

    return rows.select(*names, "texts").mapInPandas(run, translated.schema)


def _zipped(z: zipfile.ZipFile, new: dict[str, bytes]) -> bytes:
    """An archive with some entries replaced: the mimetype first and stored, all else in order and compressed."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as w:
        for info in sorted(z.infolist(), key=lambda i: i.filename != "mimetype"):
            kind = zipfile.ZIP_STORED if info.filename == "mimetype" else zipfile.ZIP_DEFLATED
            data = new[info.filename] if info.filename in new else z.read(info.filename)
            w.writestr(zipfile.ZipInfo(info.filename, info.date_time), data, compress_type=kind)
    return out.getvalue()


def rewritten(content: bytes, translations: dict[str, str], target: str, new_title: str | None = None, bilingual: bool = False, contributor: str | None = None, fixes: dict | None = None, strip_boilerplate: bool = False) -> tuple[bytes, dict[str, int]]:
    """The archive with translations put in; every other entry stays as it is, byte for byte."""
    a = Archive(content)
    totals = {"applied": 0, "lenient": 0, "untranslated": 0}
    new: dict[str, bytes] = {}
    for k, zip_path, _, nav in a.documents:
        root = _prepared(a.text(zip_path), True, strip_boilerplate, (fixes or {}).get(str(k)))
        entries = markup.segments(root, nav)
        own = {s["seg_no"]: t for s in entries if (t := translations.get(f"{k}:{s['seg_no']}"))}
        counts = markup.apply(entries, own, target if bilingual and not nav else None, markup.parents_of(root))
        for x, n in counts.items():
            totals[x] += n
        if own:
            text = markup.serialise(root)
            if bilingual and "</head>" in text:  # before the first end of a head
                text = text.replace("</head>", "<style>.translation{color:#555}</style></head>", 1)
            new[zip_path] = text.encode()
    labels = {n: t for n, _ in a.labels() if (t := translations.get(f"ncx:{n}"))}
    if labels:
        root = ET.fromstring(a.zip.read(a.ncx_path))
        texts = [t for label in _children(root, "navLabel") for t in _children(label, "text")]
        for n, t in labels.items():
            texts[n - 1].text = t
        new[a.ncx_path] = ET.tostring(root, encoding="utf-8", xml_declaration=True)
    package = _package(a, target, new_title, bilingual, contributor)
    if package is not None:
        new[a.opf_path] = package
    return _zipped(a.zip, new), totals


def _package(a: Archive, target: str, title: str | None, bilingual: bool, contributor: str | None) -> bytes | None:
    """The package with its new language and title; None, so that it stays as it is, where it is not well formed."""
    try:
        root = ET.fromstring(a.zip.read(a.opf_path)) if a.opf_path else None
    except ET.ParseError:
        root = None
    found = _children(root, "metadata") if root is not None else []
    if not found:
        return None
    meta = found[0]
    dc = "{http://purl.org/dc/elements/1.1/}"
    langs = _children(meta, "language")
    if langs and not bilingual:
        langs[0].text = target
    else:
        x = ET.Element(f"{dc}language")
        x.text = target
        meta.insert(list(meta).index(langs[0]) if langs else len(meta), x)
    if title and (titles := _children(meta, "title")):
        titles[0].text = title
    if contributor:
        x = ET.SubElement(meta, f"{dc}contributor")
        x.text = contributor
    return ET.tostring(root, encoding="utf-8", xml_declaration=True)


def rewrite_all(archives: DataFrame, translated: DataFrame, target: str, titles: DataFrame | None = None, bilingual: bool = False, strip_boilerplate: bool = False) -> DataFrame:
    """book_id, name, content and counts of every translated archive.

    A book's translations travel as one map beside its content: both are bounded by
    the book.
    """
    pairs = translated.where("translation is not null and translation <> ''").groupBy("book_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("uid", "translation")))).alias("pairs"))
    rows = _with_fixes(archives).join(pairs, "book_id", "left")
    rows = rows.join(titles, "book_id", "left") if titles is not None else rows.withColumn("new_title", F.lit(None).cast("string"))

    def run(frames):
        for pdf in frames:
            out = []
            for k, path, content, p, title, fixes in zip(pdf["book_id"], pdf["path"], pdf["content"], pdf["pairs"], pdf["new_title"], pdf["fixes"]):
                data, counts = rewritten(content, json.loads(p) if isinstance(p, str) else {}, target, title if isinstance(title, str) else None, bilingual, None, _fixes_of(fixes), strip_boilerplate)
                stem = posixpath.basename(path).rsplit(".", 1)[0]
                out.append({"book_id": k, "name": f"{stem}{'.bilingual' if bilingual else ''}.{target}.epub", "content": data, **counts})
            yield pd.DataFrame(out, columns=["book_id", "name", "content", "applied", "lenient", "untranslated"])

    return rows.select("book_id", "path", "content", "pairs", "new_title", "fixes").mapInPandas(run, "book_id string, name string, content binary, applied int, lenient int, untranslated int")

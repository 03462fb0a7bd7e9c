"""Media columns: interleaved document sequences.

A page is parsed into an ordered sequence of text and media-reference structs. A reference names its payload by
digest; a join on the digest resolves it, so that position, caption and payload stay in one row. Payload bytes live
in a store, a Parquet table of losslessly encoded images (binary PPM, 64 RGB pixels a row, so 192 bytes a row).
The join carries what is asked of a payload (by default what ``described`` reads from the stored bytes), not the bytes.

Defined results: a null text is an empty one; a null page has an empty sequence; a reference whose digest the store lacks keeps
its position and caption with null payload columns; a payload stored more than once resolves to one row; repeated rows stay repeated; an empty
table gives no rows; a text of any length is stored whole.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm.shared import documents, stored

ROW_BYTES = 192
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
OUTLINE = "n_items int, sha256 string, media array<struct<position:int,digest:string,caption:string>>"
_RAW = {"script", "style"}
#: Left out where they have an end tag of their own; of one without, nobody knows where it ends, so its content stays.
_ASIDE = {"nav", "footer"}
_HEAD = {"title", "meta", "link", "base", "script", "style", "noscript", "template"}
_BLOCKS = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "li", "ul", "ol", "figure", "figcaption", "br", "tr", "td", "table"}
#: Elements that an outer one's end tag ends with it.
_NESTED = {"div", "article", "section", "main", "header", "aside", "blockquote", "li", "ul", "ol", "tr", "td", "table", "figure", "figcaption", "head", "title"} | _ASIDE


class _Sequencer(HTMLParser):
    """Collects text blocks and ``<img src="sha256:...">`` references in reading order.

    A figure's caption goes to those of its images that no inner figure has captioned; without such it is a text item at its place.
    Open elements end with an outer one's end tag or the page; the head also where something stands that it can't hold.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.raw = 0
        self.open: list[dict] = []
        self.counts: Counter[str] = Counter()
        self.captioned: set[int] = set()

    def last(self, tag: str) -> int:
        """Where in the open elements the innermost such is, or -1."""
        if not self.counts[tag]:
            return -1
        return next(k for k in reversed(range(len(self.open))) if self.open[k]["tag"] == tag)

    def text(self) -> str:
        text = " ".join("".join(self.words).split())
        self.words = []
        return text

    def cut(self) -> None:
        if self.last("figcaption") >= 0:
            self.words.append(" ")
        elif text := self.text():
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def end(self, k: int, own: bool = False) -> None:
        """End the open elements from the k-th on, the k-th by its own end tag or not."""
        while len(self.open) > k:
            inner = self.open[-1]
            tag, at = inner["tag"], inner["at"]
            if tag == "figcaption":
                text, self.words = self.text(), inner["words"]
                self.leave()
                if text:
                    self.open[self.last("figure")]["captions"].append((at, text))
                continue
            if tag in _BLOCKS or tag in _ASIDE:
                self.cut()
            self.leave()
            if tag in _ASIDE and own and len(self.open) == k:
                del self.items[at:], self.words[inner["n_words"] :]
            elif tag == "figure":
                images = [i for i in self.items[at:] if i["kind"] == "media" and id(i) not in self.captioned]
                if images and inner["captions"]:
                    for item in images:
                        item["caption"] = " ".join(text for _, text in inner["captions"])
                        self.captioned.add(id(item))
                else:
                    for place, text in reversed(inner["captions"]):
                        self.items.insert(place, {"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _RAW:
            self.raw += 1
        head = self.last("head")
        if head >= 0:
            if tag in _HEAD:
                if tag == "title":
                    self.begin(tag)
                return
            if self.last("title") < head or tag in _BLOCKS or tag in _NESTED or tag in ("body", "img"):
                self.end(head)
        if tag in _BLOCKS or tag in _ASIDE:
            self.cut()
        if tag == "figcaption":
            figure, other = self.last("figure"), self.last("figcaption")
            if other > figure >= 0:
                self.end(other)
            if figure >= 0:
                self.begin(tag, words=self.words)
                self.words = []
        elif tag in _NESTED and tag != "title":
            self.begin(tag, n_words=len(self.words), captions=[])
        elif tag == "img" and not self.raw:
            self.cut()
            named = dict(attrs)
            src = named.get("src") or ""
            self.items.append({"kind": "media", "text": None, "digest": src[7:] if src.startswith("sha256:") else None, "caption": named.get("alt")})

    def begin(self, tag: str, **more) -> None:
        self.open.append({"tag": tag, "at": len(self.items), **more})
        self.counts[tag] += 1

    def leave(self) -> None:
        self.counts[self.open.pop()["tag"]] -= 1

    def handle_endtag(self, tag):
        if tag in _RAW:
            self.raw = max(0, self.raw - 1)
        k = self.last(tag)
        if k >= 0:
            self.end(k, own=True)
        elif tag in _BLOCKS:
            self.cut()

    def handle_data(self, data):
        head = self.last("head")
        if self.raw or self.last("title") > head >= 0:
            return
        if head >= 0 and data.strip():
            self.end(head)
        self.words.append(data)


def sequence_of(html: str | None) -> list[dict]:
    """The ordered text and media structs of one page."""
    parser = _Sequencer()
    parser.feed(html or "")
    parser.close()
    parser.end(0)
    parser.cut()
    return [{"position": k, **item} for k, item in enumerate(parser.items)]


def _sequences(html: pd.Series) -> pd.Series:
    return html.map(sequence_of)


def interleaved(html: Column) -> Column:
    """Column form of ``sequence_of``."""
    return F.pandas_udf(_sequences, SEQUENCE)(html)


def outline_of(html: str | None) -> dict:
    """How many items a page's sequence has, a digest of all of them in order, and its media references with their positions and captions."""
    items, whole = sequence_of(html), hashlib.sha256()
    for i in items:
        whole.update("\x1f".join("" if x is None else str(x) for x in (i["position"], i["kind"], i["text"], i["digest"], i["caption"])).encode("utf-8", "surrogatepass") + b"\x1e")
    return {"n_items": len(items), "sha256": whole.hexdigest(), "media": [{k: i[k] for k in ("position", "digest", "caption")} for i in items if i["kind"] == "media"]}


def _outlines(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([outline_of(x) for x in html], columns=["n_items", "sha256", "media"])


def outlined(html: Column) -> Column:
    """Column form of ``outline_of``: for long pages, whose texts then don't come back from Python."""
    return F.pandas_udf(_outlines, OUTLINE)(html)


def page_of(text: Column, digest: Column, caption: Column) -> Column:
    """A page of a text's lines as paragraphs, with a figure of its payload after the first half of them."""
    safe = F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.split(safe, "\n", -1)
    half = F.ceil(F.size(lines) / 2).cast("int")
    shown = lambda some: F.concat(F.lit("<p>"), F.array_join(some, "</p><p>"), F.lit("</p>"))
    figure = F.concat(F.lit('<figure><img src="sha256:'), digest, F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>"))
    return F.concat(F.lit("<article>"), shown(F.slice(lines, F.lit(1), half)), figure, shown(F.slice(lines, half + 1, F.size(lines))), F.lit("</article>"))


def payload(text: Column) -> Column:
    """UTF-8 bytes of a text, padded with blanks to a positive multiple of 192."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    rows = F.greatest(F.ceil(F.octet_length(raw) / ROW_BYTES), F.lit(1))
    return F.call_function("rpad", raw, (rows * ROW_BYTES).cast("int"), F.lit(b" "))


def image(samples: Column) -> Column:
    """Those bytes as the samples of a binary PPM image."""
    rows = (F.octet_length(samples) / ROW_BYTES).cast("int")
    return F.concat(F.concat(F.lit("P6\n64 "), rows.cast("string"), F.lit("\n255\n")).cast("binary"), samples)


def write_store(rows: DataFrame, text: str = "text") -> DataFrame:
    """Store each row's payload: ``rows`` without its text, plus n_bytes, digest and media, which take the place of columns so called. The bytes stay in this table."""
    samples = rows.withColumns({"n_bytes": F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"), "media": payload(F.col(text))}).drop(text)
    return stored(samples.withColumn("digest", F.sha2("media", 256)).withColumn("media", image(F.col("media"))), "media", compression="zstd")


def samples_of(media: bytes) -> bytes:
    """The sample bytes of a stored image."""
    magic, width_height, depth, samples = media.split(b"\n", 3)
    width, height = map(int, width_height.split())
    if magic != b"P6" or depth != b"255" or len(samples) != width * height * 3:
        raise ValueError("not an image of this store")
    return samples


def feature_of(samples: bytes) -> str:
    """Mean and spread of the samples, and a 64-bit difference hash of 65 equal stretches."""
    x = np.frombuffer(samples, np.uint8)
    edges = np.arange(65) * len(x) // 65
    sums = np.add.reduceat(x.astype(np.int64), np.minimum(edges, len(x) - 1))
    bits = int("".join("1" if b > a else "0" for a, b in zip(sums[:-1], sums[1:])), 2)
    mean, square = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    return f"{mean / len(x):.3f}:{square / len(x) - (mean / len(x)) ** 2:.3f}:{bits:016x}"


def _features(samples: pd.Series) -> pd.Series:
    return samples.map(feature_of)


def described(media: Column) -> Column:
    """What a stored image holds, read back from its bytes; an image that this store can't have written is an error. Only the feature needs Python."""
    head = F.decode(F.substring(media, 1, 40), "ISO-8859-1")
    start, rows = (F.regexp_extract(head, "^P6\n64 ([0-9]+)\n255\n", k) for k in (0, 1))
    whole = (start != "") & (F.octet_length(media) == F.length(start) + rows.cast("int") * ROW_BYTES)
    samples = F.when(whole, F.substring(media, F.length(start) + 1, F.octet_length(media))).otherwise(F.raise_error(F.lit("not an image of this store")).cast("binary"))
    return F.struct(
        F.octet_length(samples).cast("long").alias("payload_bytes"), F.sha2(samples, 256).alias("payload_sha256"), F.crc32(F.substring(samples, -16, 16)).alias("tail_crc32"),
        F.octet_length(media).cast("long").alias("media_bytes"), F.sha2(media, 256).alias("media_sha256"), F.pandas_udf(_features, "string")(samples).alias("feature"),
    )


def store_index(store: DataFrame) -> DataFrame:
    """One row per digest with what the stored bytes hold. Written, so that a later join deals out both sides itself and can split a hot digest."""
    read = store.select("digest", described(F.col("media")).alias("d"))
    return stored(read.groupBy("digest").agg(F.min("d").alias("d")).select("digest", "d.*"), "media_index")


def resolve(sequences: DataFrame, index: DataFrame, sequence: str = "sequence") -> DataFrame:
    """One row per item of each sequence, with the other columns of the row and what the index says of its digest. Columns of the row named like these are left out."""
    made = {"position", "kind", "text", "digest", "caption", *index.columns}
    rest = [F.col("row").getField(c).alias(c) for c in sequences.columns if c != sequence and c not in made]
    items = sequences.select(F.struct("*").alias("row"), F.explode(sequence).alias("item")).select(*rest, "item.*")
    return items.join(index, "digest", "left")


def op1_media_sequences(spark, sf_dir):
    """Every document as a page of its own paragraphs around a figure whose image holds the whole text. The figure's place among them, its caption and a digest of the whole sequence come with it."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    index = store_index(write_store(docs))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    caption = F.concat(F.lit("document of "), n_bytes.cast("string"), F.lit(" bytes"))
    pages = docs.select("doc_id", n_bytes.alias("n_bytes"), outlined(page_of(F.col("text"), F.sha2(payload(F.col("text")), 256), caption)).alias("o"))
    found = resolve(pages.select("doc_id", "n_bytes", F.col("o.n_items").alias("n_items"), F.col("o.sha256").alias("sequence_sha256"), F.col("o.media").alias("sequence")), index)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_items", "sequence_sha256")

"""Language of web pages by Bayesian fusion of evidence.

Four kinds of evidence meet in log space, per language:

* text: byte trigrams of the visible text under models of labelled texts, the mean over trigrams
  times a fixed weight (trigrams are far from independent);
* the language that the markup declares, and the suffix of the address: how often pages of each
  language declare it or have it, from soft counts over all pages, smoothed;
* the host: a prior from the other pages of the host, smoothed towards its domain, that towards
  all pages. A page's own share is taken out of each count before it is used.

Soft counts are the text's own posterior, so that declarations are weighed by how far they agree
with texts. All counts are grouped aggregations over narrow rows; a host with a third of all pages
is added up before the shuffle. Models are fitted on a bounded sample: about ``SAMPLE`` texts of
each language, all if there are fewer, chosen by a hash, so that a language of any share of a table
of any size keeps its model; languages are those with ``LEAST_TEXTS`` labelled texts.

Defined results: null or empty markup gives no text evidence, a missing declaration, suffix or
host gives none of its kind; without any evidence the languages' overall shares are left. Without
labelled texts the language is null. Repeated rows count again; null keys stay. Only the named
columns are read, so other columns do no harm.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexferry.llm.common import BROADCAST_KEYS, slices
from codexferry.storage import materialize

SAMPLE, LEAST_TEXTS = 2000, 2
SIZE = 1 << 16
#: Trigrams that a text's evidence counts for, however long it is; fewer count themselves.
TRIGRAMS = 30.0
#: Pages that the next wider prior counts for, and the smoothing of declarations and suffixes.
HOST, DOMAIN, SMOOTH = 5.0, 20.0, 0.5

_HIDDEN = regex.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)")
_TAG = regex.compile(r"<[^<>]*>")
_LANG = regex.compile(r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?\s*([a-z]{2,3})\b""")
_HOST = regex.compile(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def trigrams(text: str) -> np.ndarray:
    """Codes of the byte trigrams of the lower-cased letters and blanks of a text."""
    data = np.frombuffer(f" {' '.join(regex.findall(r'[^\W\d_]+', text.lower()))} ".encode(), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.empty(0, np.uint32)
    codes = data[:-2] * np.uint32(65536) + data[1:-1] * np.uint32(256) + data[2:]
    return (codes * np.uint32(2654435761)) >> np.uint32(32 - 16)


def visible(markup: str) -> str:
    return html.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", markup)))


def address(url: str | None) -> tuple[str | None, str | None, str | None]:
    """Host, domain (its last two labels) and suffix of an address."""
    found = _HOST.match(url or "")
    if not found:
        return None, None, None
    host = found.group(1).lower().rstrip(".")
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1] if len(labels) > 1 else None


@dataclass
class TextModel:
    languages: list[str]
    logs: np.ndarray  # language x trigram

    def evidence(self, text: str) -> np.ndarray:
        codes = trigrams(text)
        if not len(codes):
            return np.zeros(len(self.languages))
        return self.logs[:, codes].mean(axis=1) * min(TRIGRAMS, len(codes))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> TextModel:
    """Trigram models of the languages, each from a bounded sample of its texts."""
    known = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sizes = materialize(known.groupBy("lang").agg(F.count("*").alias("texts")).where(F.col("texts") >= LEAST_TEXTS))
    known = known.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_KEYS else sizes, "lang")
    known = known.where(F.pmod(F.xxhash64("key", "text"), F.lit(1 << 40)) <= F.lit(float(1 << 40)) * sample / F.col("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            groups: dict = {}
            for t, name in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                groups.setdefault(name, []).append(trigrams(t))
            for name, codes in groups.items():
                found, n = np.unique(np.concatenate(codes), return_counts=True)
                columns = [pa.array([name] * (len(found) + 1)), pa.array([*found.tolist(), -1]), pa.array([*n.tolist(), len(codes)])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "code", "n"])

    counts = known.select("text", "lang").mapInArrow(run, "lang string, code long, n long")
    # At most 65,537 rows per language of the sample.
    rows = counts.groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    texts = rows[rows["code"] == -1].set_index("lang")["n"]
    languages = sorted(texts[texts >= LEAST_TEXTS].index)
    table = np.zeros((len(languages), SIZE))
    for i, name in enumerate(languages):
        own = rows[(rows["lang"] == name) & (rows["code"] >= 0)]
        table[i, own["code"].to_numpy(np.int64)] = own["n"]
    smooth = table + 0.5
    return TextModel(languages, np.log(smooth / smooth.sum(axis=1, keepdims=True)))


def evidence(pages: DataFrame, model: TextModel, key: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """(key, host, domain, suffix, declared, text evidence per language) per page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    names = [key, "host", "domain", "suffix", "declared", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, markup):
            pages_ = [x or "" for x in batch[markup].to_pylist()]
            found = [address(u) for u in batch[url].to_pylist()]
            declared = [x.group(1).lower() if (x := _LANG.search(p)) else None for p in pages_]
            texts = [m.evidence(visible(p)).tolist() for p in pages_]
            columns = [pa.array([f[i] for f in found], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch[key], *columns, pa.array(declared, pa.string()), pa.array(texts, pa.list_(pa.float64()))], names)

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, url, markup).mapInArrow(run, f"`{key}` {kind}, host string, domain string, suffix string, declared string, text array<double>")


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def identify(pages: DataFrame, model: TextModel, key: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """(key, lang, confidence, declared, host, text_lang) per page."""
    kind = pages.schema[key].dataType.simpleString()
    if not model.languages:
        none = evidence(pages, model, key, url, markup)
        missing = F.lit(None)
        return none.select(key, missing.cast("string").alias("lang"), missing.cast("double").alias("confidence"), "declared", "host", missing.cast("string").alias("text_lang"))
    n = len(model.languages)
    soft = evidence(pages, model, key, url, markup).withColumn("q", _softmax(F.col("text")))
    soft = materialize(soft)

    def counts(by: str | None) -> DataFrame:
        """Soft counts per language, of all pages or by a column."""
        sums = F.array(*(F.coalesce(F.sum(F.col("q")[i]), F.lit(0.0)) for i in range(n)))
        grouped = soft.where(F.col(by).isNotNull()).groupBy(F.col(by).alias(f"by_{by}")) if by else soft
        out = materialize(grouped.agg(sums.alias(f"n_{by or 'all'}")))
        return F.broadcast(out) if not by or out.count() <= BROADCAST_KEYS else out

    rows = soft.crossJoin(counts(None))  # one row
    for by in ("host", "domain", "suffix", "declared"):
        rows = rows.join(counts(by), F.col(by) == F.col(f"by_{by}"), "left").drop(f"by_{by}")
    # Without the page itself.
    less = lambda c: F.when(c.isNotNull(), F.zip_with(c, "q", lambda a, b: F.greatest(a - b, F.lit(0.0))))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumns({f"n_{x}": less(F.col(f"n_{x}")) for x in ("all", "host", "domain", "suffix", "declared")})
    each = F.sequence(F.lit(0), F.lit(n - 1))
    rows = rows.withColumn("p_all", F.transform(each, lambda i: (F.get("n_all", i) + SMOOTH) / (total(F.col("n_all")) + SMOOTH * n)))

    def narrowed(counts_: str, wide: str, weight: float) -> Column:
        own = F.transform(each, lambda i: (F.get(counts_, i) + weight * F.get(wide, i)) / (total(F.col(counts_)) + weight))
        return F.when(F.col(counts_).isNull(), F.col(wide)).otherwise(own)

    rows = rows.withColumn("p_domain", narrowed("n_domain", "p_all", DOMAIN)).withColumn("prior", narrowed("n_host", "p_domain", HOST))

    def likely(by: str) -> Column:
        """log P(value | language); a value's share among all pages is the smoothing."""
        share = lambda: (total(F.col(f"n_{by}")) + SMOOTH) / (total(F.col("n_all")) + 2 * SMOOTH)
        own = F.transform(each, lambda i: F.log((F.get(f"n_{by}", i) + SMOOTH * share()) / (F.get("n_all", i) + SMOOTH)))
        return F.when(F.col(f"n_{by}").isNull(), F.transform(each, lambda i: F.lit(0.0))).otherwise(own)

    rows = rows.withColumns({"l_declared": likely("declared"), "l_suffix": likely("suffix")})
    logs = F.transform(each, lambda i: F.get("text", i) + F.log(F.get("prior", i)) + F.get("l_declared", i) + F.get("l_suffix", i))
    rows = rows.withColumn("p", _softmax(logs))
    names = F.array(*(F.lit(x) for x in model.languages))
    best = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    unknown = F.forall("text", lambda x: x == 0)
    text_lang = F.when(~unknown, best(F.col("q")))
    return rows.select(F.col(key).cast(kind).alias(key), best(F.col("p")).alias("lang"), F.array_max("p").alias("confidence"), "declared", "host", text_lang.alias("text_lang"))

"""Secret scans: fixed patterns plus dictionary-primed compression novelty.

The fixed patterns find assignments, access keys and long hex strings. Beyond them, any long
token near a sensitive word, before or behind it, is a candidate, and so is every token of a block
of adjoining ones (the lines of a key, the parts of a signed token) of which one is. A candidate's
novelty is what it adds to the compressed size of the surrounding text, by a zstandard compressor
primed with a dictionary of identifiers and code words; it alone decides. The dictionary holds fixed
words and the most frequent word parts around the sensitive words of all documents: names that a
corpus uses are cheap there, random strings are not. Candidates above NOVEL_BITS a character are
reported.

One scan counts words around sensitive words (at most DICTIONARY_WORDS come to the driver), one scan
finds secrets; no text is shuffled. Null text is empty, texts of any length are scanned whole,
rows that repeat get the same spans, and an empty table leaves the fixed words alone. Spans count
code points, end exclusive. Extra columns pass through; the operator adds one column, ``secrets``.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm import scratch

#: Fixed patterns, and kinds in the order that breaks ties.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "novel")

CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
SENSITIVE = r"(?i:key|secret|token|passw|pwd|auth|credential|bearer|private|signature|session)"
#: Code points before a candidate that can make it sensitive; text around it that primes the compressor.
CONTEXT_BEFORE, AROUND = 48, 256
NOVEL_BITS, NOVEL_BYTES = 6.25, 12
#: What may stand between the tokens of a block.
ADJOINING = r"[\s.:,;|\"'\\-]{1,4}"
#: Word parts learned, their lengths, and code points around a sensitive word that they come from.
DICTIONARY_WORDS, WORD_PART, AROUND_WORD = 1500, r"[A-Z]?[a-z]{2,15}|[A-Z]{3,15}", 64
IDENTIFIERS = (
    "import from class def function return const let var public static void string int float bool true false null none self this new "
    "config settings environment variable client server request response header content-type application/json http https localhost "
    "username password passwd secret token access_key api_key apiKey private_key public_key client_id client_secret authorization bearer "
    "credentials session cookie signature certificate database connection user_id account_name bucket region endpoint version timestamp "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ the and for that with this from are not you all have was but "
)


class Novelty:
    """Marginal compressed size of a string beside its surroundings, whatever the case of letters."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        import zstandard

        primer = zstandard.ZstdCompressionDict(identifiers.lower().encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        # The fast strategy leaves unmatched bytes as they are, so what a string costs does not depend on the letters around it.
        fast = zstandard.ZstdCompressionParameters(
            window_log=16, chain_log=14, hash_log=15, search_log=1, min_match=4, target_length=1, strategy=zstandard.STRATEGY_FAST, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        primer.precompute_compress(compression_params=fast)
        packer = zstandard.ZstdCompressor(compression_params=fast, dict_data=primer)
        self.size = lambda b: len(packer.compress(b))

    def bytes_for(self, candidate: str, before: str, after: str) -> int:
        around = (before + "\n" + after).replace(candidate, "").lower().encode("utf-8", "replace")
        return self.size(around + candidate.lower().encode("utf-8", "replace")) - self.size(around)


@functools.cache
def _compiled(identifiers: str):
    return re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX), re.compile(CANDIDATE), re.compile(SENSITIVE), re.compile(ADJOINING), Novelty(identifiers)


def _near_words(tokens: list[re.Match], words: list[re.Match]) -> list[bool]:
    """Whether a sensitive word stands whole within CONTEXT_BEFORE code points before or behind each token."""
    starts, ends = [w.start() for w in words], [w.end() for w in words]
    out = []
    for t in tokens:
        last = bisect.bisect_right(ends, t.start()) - 1  # the last word that ends before it
        first = bisect.bisect_left(starts, t.end())  # the first word that begins behind it
        before = last >= 0 and starts[last] >= t.start() - CONTEXT_BEFORE
        out.append(before or (first < len(ends) and ends[first] <= t.end() + CONTEXT_BEFORE))
    return out


def _spread(tokens: list[re.Match], near: list[bool], adjoining: re.Pattern, text: str) -> list[bool]:
    """A block of adjoining tokens is sensitive as a whole if one of them is."""
    out, a = list(near), 0
    for k in range(1, len(tokens) + 1):
        if k == len(tokens) or not adjoining.fullmatch(text, tokens[k - 1].end(), tokens[k].start()):
            out[a:k] = [any(near[a:k])] * (k - a)
            a = k
    return out


def scan(text: str | None, identifiers: str = IDENTIFIERS, novel_bits: float = NOVEL_BITS) -> list[tuple[str, int, int]]:
    """All spans of one text: (kind, start, end), by start, then kind."""
    if not text:
        return []
    assign, access, hexes, candidate, sensitive, adjoining, novelty = _compiled(identifiers)
    found = [("assign", m.start(), m.end()) for m in assign.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [("access", m.start(), m.end()) for m in access.finditer(text)] if "AKIA" in text else []
    tokens = list(candidate.finditer(text))
    # A long hex string lies within one candidate, so only those are searched.
    found += [("hex", m.start(), m.end()) for t in tokens for m in hexes.finditer(text, t.start(), t.end())]
    base = sorted((s, e) for _, s, e in found)
    starts, reach = [s for s, _ in base], list(itertools.accumulate((e for _, e in base), max))
    words = list(sensitive.finditer(text)) if tokens else []
    near = _spread(tokens, _near_words(tokens, words), adjoining, text) if words else []
    for t, wanted in zip(tokens, near, strict=False):
        s, e, word = t.start(), t.end(), t[0]
        before = bisect.bisect_left(starts, e)  # fixed spans that begin before this ends
        if not wanted or (before and reach[before - 1] > s):
            continue
        added = novelty.bytes_for(word, text[max(0, s - AROUND) : s], text[e : e + AROUND])
        if added >= NOVEL_BYTES and 8 * added >= novel_bits * (e - s):
            found.append(("novel", s, e))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _word_counts(batches):
    """Counts of the word parts around sensitive words, a row for each part and batch."""
    sensitive, part = re.compile(SENSITIVE), re.compile(WORD_PART)
    for b in batches:
        counts: Counter[str] = Counter()
        for t in b.column(0).to_pylist():
            done = 0
            for m in sensitive.finditer(t or ""):
                counts.update(part.findall(t, max(done, m.start() - AROUND_WORD), m.end() + AROUND_WORD))
                done = m.end() + AROUND_WORD
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def learn(docs: DataFrame, text: str = "text", words: int = DICTIONARY_WORDS) -> str:
    """The dictionary: fixed words behind the most frequent word parts of docs, the most frequent last."""
    scratch.bounded_batches(docs.sparkSession)
    counts = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    best = counts.where("n > 1").orderBy(F.desc("n"), "word").limit(words).collect()
    return " ".join([r["word"] for r in reversed(best)] + [IDENTIFIERS])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_secrets(docs: DataFrame, text: str = "text", into: str = "secrets", identifiers: str | None = None) -> DataFrame:
    """docs with an array of the spans found in each text; a column named like it is replaced.

    The dictionary is learned from docs unless one is given.
    """
    known = learn(docs, text) if identifiers is None else identifiers
    scratch.bounded_batches(docs.sparkSession)

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in scan(t, known)] for t in texts.to_pylist()], kind)

    return docs.withColumn(into, spans(F.col(f"`{text}`")))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced; ``n_chars``, where there is one, follows."""
    inside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{text}`").alias("_text"))
    found = find_secrets(inside, "_text", "_secrets")
    t, any_ = F.col("_text"), F.size("_secrets") > 0
    cut = lambda a, b: F.substring(t, a.cast("int") + 1, (b - a).cast("int"))
    # Spans come by start: what overlaps the part already replaced only extends it.
    done = F.aggregate(
        "_secrets",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, x: F.struct(F.when(x["start"] >= acc["at"], F.concat(acc["out"], cut(acc["at"], x["start"]), F.lit(mark))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], x["end"]).alias("at")),
        lambda acc: F.concat(acc["out"], cut(acc["at"], F.length(t).cast("long"))),
    )
    new = found.withColumn("_new", F.when(any_, done).otherwise(t))
    of = lambda c: F.col("_new") if c == text else F.when(any_, F.length("_new").cast("long")).otherwise(F.col("_doc.n_chars")) if c == "n_chars" else F.col(f"_doc.`{c}`")
    return new.select(*[of(c).alias(c) for c in docs.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op7_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[of(k) for k in BASE_KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))


def secrets_base(spark, sf_dir: str) -> DataFrame:
    """What the fixed patterns find, by the same scan, without a learned dictionary."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), identifiers=IDENTIFIERS)
    of = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[of(k) for k in BASE_KINDS], F.sha2(_joined(base), 256).alias("base_sha256"))

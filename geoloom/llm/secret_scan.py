"""Operator 6: secrets by fixed patterns and by automata inferred from the credentials these find."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import Automaton, infer
from .common import byte_slices, checkpointed, doc_columns, parted, row_key, tidy

# Fixed patterns of the base kinds, in their order.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "format")
_SPANS = "array<struct<kind:int,start:long,stop:long,secret:string>>"
_FOUND = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("secret", pa.string())]))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, stop, secret) in code points, leftmost and non-overlapping in each kind.

    An assignment's span is the whole match and its secret the value.  A match whose
    value is too short is used up and dropped.
    """
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_HINTS) or not text.isascii():
        out += [(0, m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text)]
    out += [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return out


def candidate_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Runs of 16 or more credential characters, letters and digits among them, that no base span touches."""
    out = []
    blocks = iter(sorted((a, b) for _, a, b, _ in taken))
    block, reach = next(blocks, None), -1  # reach: where the spans that begin before the run end
    for m in _CANDIDATE.finditer(text):
        start, stop = m.span()
        while block and block[0] < stop:
            reach, block = max(reach, block[1]), next(blocks, None)
        if reach <= start and _DIGIT.search(m[0]) and _LETTER.search(m[0]):
            out.append((3, start, stop, m[0]))
    return out


def fit_formats(found: DataFrame, per_kind: int = 300) -> list[Automaton]:
    """One automaton for each base kind that has 20 labelled credentials or more.

    The labels are the kinds of the base spans.  Of each kind the ``per_kind`` distinct
    credentials with the smallest hashes are used: the fit's size is bounded and
    doesn't depend on how the rows are dealt.
    """
    labelled = found.select(F.explode("spans").alias("s")).where("s.kind < 3").select("s.kind", "s.secret").distinct()
    automata = []
    for kind in range(3):
        drawn = labelled.where(F.col("kind") == kind).select("secret", F.xxhash64("secret").alias("h")).orderBy("h", "secret").limit(per_kind)
        samples = [r["secret"] for r in drawn.collect()]
        if len(samples) >= 20:
            automata.append(infer(samples))
    return automata


def secret_spans(docs: DataFrame, per_kind: int = 300, margin: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans, text_hash)`` for each row of ``docs``: all spans, by start and kind.

    Whole texts are scanned once for the base kinds and for candidates.  Automata
    fitted on the base finds (:func:`fit_formats`) then score every candidate; one
    whose mean log-likelihood under some automaton reaches the low end (2nd
    percentile) of that automaton's own credentials, less ``margin``, is added as
    kind ``format``.  Base spans always stay.

    Null and empty texts have no spans.  Null and repeated ids are rows like others.
    Without 20 credentials of a kind there is no automaton and nothing is added.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_slices(whole, "text"):
                out = []
                for text in b.column("text").to_pylist():
                    base = base_spans(text or "")
                    out.append([dict(zip(("kind", "start", "stop", "secret"), s, strict=True)) for s in base + candidate_spans(text or "", base)])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(out, _FOUND)], ["doc_id", "text_hash", "spans"])
        tidy()

    own = doc_columns(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    found = checkpointed(own.mapInArrow(scan, f"doc_id long, text_hash long, spans {_SPANS}"))
    automata = docs.sparkSession.sparkContext.broadcast(fit_formats(found, per_kind))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for spans in b.column("spans").to_pylist():
                kept = [s for s in spans if s["kind"] < 3 or any(a.score(s["secret"]) >= a.typical - margin for a in automata.value)]
                out.append(sorted(kept, key=lambda s: (s["start"], s["kind"])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(out, _FOUND)], ["doc_id", "text_hash", "spans"])

    return found.mapInArrow(judge, f"doc_id long, text_hash long, spans {_SPANS}")


def secret_digests(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)``: counts, the digest of the base spans and all spans as text."""
    found = secret_spans(docs, **options)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for spans in b.column("spans").to_pylist():
                base = [s for s in spans if s["kind"] < 3]
                written = [",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['stop']}" for s in part) for part in (base, spans)]
                rows.append((*(sum(s["kind"] == k for s in base) for k in range(3)), hashlib.sha256(written[0].encode()).hexdigest(), written[1]))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return found.mapInArrow(digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str, spans: list[dict], mask: str) -> str:
    """The text with each span's secret replaced by ``mask``; spans that touch become one."""
    out, at = [], 0
    cuts: list[list[int]] = []
    for start, stop in sorted((s["stop"] - len(s["secret"]), s["stop"]) for s in spans):
        if cuts and start <= cuts[-1][1]:
            cuts[-1][1] = max(cuts[-1][1], stop)
        else:
            cuts.append([start, stop])
    for start, stop in cuts:
        out += [text[at:start], mask]
        at = stop
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, mask: str = "[secret]", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the secrets of all spans masked; every row and column stays.

    The spans come back to their texts by id and text hash; only rows that may have
    any are moved.
    """
    spans = secret_spans(docs, id_col=id_col, text_col=text_col, **options).where(F.size("spans") > 0)
    spans = checkpointed(spans.dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h"), F.col("spans").alias("_spans")))
    calm, doubtful = parted(docs, spans.select(row_key("_i", "_h").alias("key")), id_col, text_col)
    both = doubtful.join(spans, doubtful["_id"].eqNullSafe(spans["_i"]) & (doubtful["_hash"] == spans["_h"]), "left")
    names = docs.columns

    def mask_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_slices(whole, text_col):
                texts = [masked(t, s, mask) if s else t for t, s in zip(b.column(text_col).to_pylist(), b.column("_spans").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else b.column(c) for c in names], names)
        tidy()

    return calm.select(*names).unionByName(both.select(*names, "_spans").mapInArrow(mask_all, docs.schema))

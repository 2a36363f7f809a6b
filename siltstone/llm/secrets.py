"""Operator 6: secrets in whole texts.

Three base patterns (``assign``, ``access``, ``hex``) are always reported.  The method adds ``entropy`` spans: candidate
strings of one character class are slid over by a window whose Shannon entropy is kept by incremental counts, and
windows above the class's threshold are joined, unless an allow-list pattern covers the candidate.  Such a span may overlap
base spans; it's left out only where they cover it whole.

Whole blocks of bytes are screened by numpy first (run lengths of a class) and by substring search, so that patterns
run over few texts; screens never drop a text that a pattern could match.

Null and empty texts have no spans: counts 0 and the SHA-256 of the empty string.  Repeated rows give repeated results, a null
doc_id stays null, an empty table gives an empty result, and texts of any length are scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.words import text_blocks

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


@dataclass(frozen=True)
class EntropyClass:
    """Runs of ``characters`` of at least ``window`` are candidates; a window counts from ``bits`` on."""

    characters: str
    window: int
    bits: float


@dataclass(frozen=True)
class SecretConfig:
    classes: tuple[EntropyClass, ...] = (EntropyClass("0-9A-Fa-f", 24, 3.0), EntropyClass("A-Za-z0-9+/=", 24, 4.0), EntropyClass("A-Za-z0-9_-", 24, 4.0))
    #: Patterns of well-known harmless candidates; a candidate that one of them matches whole is suppressed.
    allow: tuple[str, ...] = (
        r"[0-9]+",
        r"[A-Za-z]+",
        r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
        r"(?:[a-z]+[-_/])+[a-z]*[0-9]{0,4}",
        r"(.)\1+",
        r".*(?:EXAMPLE|example|placeholder|PLACEHOLDER|xxxxxxxx|XXXXXXXX|0123456789|abcdefgh|ABCDEFGH).*",
    )
    redaction: str = "[SECRET]"
    min_assign: int = field(default=6)
    min_access: int = field(default=20)
    min_hex: int = field(default=24)


def entropy_windows(text: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Joined windows of ``text`` with an entropy of ``bits`` or more and both letters and digits."""
    term = [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, digits, limit = 0.0, 0, window * (math.log2(window) - bits) + 1e-9
    found: list[list[int]] = []
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        total += term[n + 1] - term[n]
        counts[c] = n + 1
        digits += c.isdigit()
        if i >= window:
            old = text[i - window]
            n = counts[old]
            total += term[n - 1] - term[n]
            counts[old] = n - 1
            digits -= old.isdigit()
        if i >= window - 1 and total <= limit and 0 < digits < window:
            start = i - window + 1
            if found and start <= found[-1][1]:
                found[-1][1] = i + 1
            else:
                found.append([start, i + 1])
    return [(a, b) for a, b in found]


def join_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``ranges`` in order, those that overlap or touch joined."""
    joined: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if joined and s <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(e, joined[-1][1]))
        else:
            joined.append((s, e))
    return joined


class Scanner:
    """Finds the spans of one text: (start, kind number, end) in order of start, then kind."""

    def __init__(self, cfg: SecretConfig) -> None:
        self.cfg = cfg
        self.classes = [(re.compile(f"[{c.characters}]{{{c.window},}}"), c.window, c.bits) for c in cfg.classes]
        self.allow = re.compile("|".join(f"(?:{x})" for x in cfg.allow)) if cfg.allow else None
        self.shortest = min([cfg.min_hex, *(c.window for c in cfg.classes)])
        wide = re.compile("[" + "".join(c.characters.strip("-") + ("\\-" if c.characters.endswith("-") else "") for c in cfg.classes) + "a-f0-9]")
        self.member = np.array([b < 128 and bool(wide.match(chr(b))) for b in range(256)])

    def screened(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which documents hold a run of candidate characters that is long enough."""
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = self.member[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[0::2], edge[1::2]
        long = ends - starts >= self.shortest
        hit = np.zeros(len(bounds) - 1, bool)
        # a run may cross documents: mark all that it touches, the patterns decide
        for s, e in zip(starts[long], ends[long], strict=True):
            i, j = np.searchsorted(bounds, s, "right") - 1, np.searchsorted(bounds, e, "left")
            hit[i:j] = True
        return hit

    def spans(self, text: str, runs: bool = True) -> list[tuple[int, int, int]]:
        cfg, out = self.cfg, []
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= cfg.min_assign:
                out.append((m.start(), 0, m.end()))
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= cfg.min_access:
                out.append((m.start(), 1, m.end()))
        if runs:
            for m in _HEX.finditer(text):
                if m.end() - m.start() >= cfg.min_hex:
                    out.append((m.start(), 2, m.end()))
            added: list[tuple[int, int]] = []
            for pattern, window, bits in self.classes:
                for m in pattern.finditer(text):
                    if self.allow is None or not self.allow.fullmatch(m[0]):
                        added += [(m.start() + a, m.start() + b) for a, b in entropy_windows(m[0], window, bits)]
            base = join_ranges([(s, e) for s, _, e in out])
            for s, e in join_ranges(added):
                at = bisect_right(base, (s, len(text) + 1)) - 1
                if at < 0 or base[at][1] < e:
                    out.append((s, 3, e))
        return sorted(out)


def _scan(cfg: SecretConfig, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    scanner = Scanner(cfg)
    for at, end, data, bounds in text_blocks(column):
        runs = scanner.screened(data, bounds)
        raw = data.tobytes()
        low = raw.lower()
        words = any(k in low for k in _KEYWORDS) or b"AKIA" in raw
        for i in range(end - at):
            a, b = bounds[i], bounds[i + 1]
            named = words and (any(low.find(k, a, b) >= 0 for k in _KEYWORDS) or raw.find(b"AKIA", a, b) >= 0)
            yield at + i, scanner.spans(raw[a:b].decode(), bool(runs[i])) if named or runs[i] else []


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_batches(cfg: SecretConfig):
    """A mapInArrow function: (id, text) to counts, digest and spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [spans for _, spans in _scan(cfg, batch.column(1))]
            counts = [[sum(k == kind for _, k, _ in spans) for spans in rows] for kind in range(4)]
            base = [hashlib.sha256(join_spans([x for x in spans if x[1] < 3]).encode()).hexdigest() for spans in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(base, pa.string()), pa.array(list(map(join_spans, rows)), pa.string()), pa.array(counts[3], pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"],
            )

    return run


def scan_secrets(docs: DataFrame, cfg: SecretConfig = SecretConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy) for every row; no shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan_batches(cfg), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """``text`` with every span, overlapping ones joined, replaced by ``mark``."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact_batches(cfg: SecretConfig, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text_at)
            texts = column.to_pylist()
            for i, spans in _scan(cfg, column):
                if spans:
                    texts[i] = redact(texts[i], spans, cfg.redaction)
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, column.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def redact_secrets(docs: DataFrame, cfg: SecretConfig = SecretConfig(), text_col: str = "text") -> DataFrame:
    """``docs`` with all secrets in ``text_col`` replaced; other columns and all rows stay."""
    return docs.mapInArrow(redact_batches(cfg, docs.columns.index(text_col)), docs.schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all documents."""
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

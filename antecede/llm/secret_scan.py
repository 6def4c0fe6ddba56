"""Secret scan: fixed patterns, plus strings that a tokenizer can hardly shorten.

Text of a language falls into long tokens of a byte-pair vocabulary, random strings into many
short ones. Every run of at least ``MIN_RUN`` key characters is tokenised;
when it has fewer than ``MAX_RATIO`` characters per token it is reported as kind ``token``, unless
it is a known digest (hex of a usual length), a UUID, or overlaps a span of the fixed patterns.

The vocabulary file is read by the driver and broadcast (about 1 MB), so executors need no file of their own.

Defined cases: null and empty texts have no span; long texts are scanned whole; offsets are code points, the end exclusive;
repeated rows are scanned each on its own; an empty table gives no rows; other columns are passed by.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from antecede.llm.common import map_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MIN_RUN, MAX_RATIO = 20, 2.0
KINDS = ("assign", "access", "hex", "token")

# The base patterns, and the pre-tokenizer pattern of the vocabulary.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

HINTS = ("passw", "secret", "token", "apikey", "api_key")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
DIGEST = re.compile(r"(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128})")

SCHEMA = (
    "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_token bigint, "
    "base_sha256 string, spans string"
)


_LOADED: dict = {}


def encoding(path: str, content: bytes | None = None):
    """The vocabulary, made once per Python worker from its content, or from the file where none is given."""
    if path not in _LOADED:
        import tiktoken

        if content is None:
            with open(path, "rb") as file:
                content = file.read()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        _LOADED[path] = tiktoken.Encoding("scan", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), sorted."""
    found = []
    folded = text.lower()
    if any(hint in folded for hint in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, base: list[tuple[int, int, int]], path: str = VOCABULARY, ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """Runs with few characters per token that no base span touches."""
    out = []
    for m in RUN.finditer(text):
        run, start, end = m.group(), m.start(), m.end()
        if DIGEST.fullmatch(run) or UUID.fullmatch(run) or any(s < end and start < e for s, _, e in base):
            continue
        if len(run) < ratio * len(encoding(path).encode_ordinary(run)):
            out.append((start, 3, end))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secret_scan(docs: DataFrame, vocabulary: str = VOCABULARY, ratio: float = MAX_RATIO) -> DataFrame:
    """One row per document: number of spans per kind, digest of the base spans, all spans."""

    with open(vocabulary, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding(vocabulary, content.value)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base = base_spans(text) if text else []
                more = random_spans(text, base, vocabulary, ratio) if text else []
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                out.append((doc_id, *counts, len(more), digest, joined(sorted(base + more))))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "n_token", "base_sha256", "spans"])

    return map_batches(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text"), scan, SCHEMA)

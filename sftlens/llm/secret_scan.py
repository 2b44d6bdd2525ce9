"""Secrets in texts: fixed patterns, and random strings by token efficiency.

A tokenizer's vocabulary was made from text people write, so ordinary strings need few
tokens per character and random ones many. Runs of key-like characters with at most
``ratio`` characters per token are reported, unless they are known digests, identifiers or
already covered by a pattern.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sftlens.llm.tables import text_of
from sftlens.llm.textarrays import byte_set, slices

# Fixed patterns. On bytes, so letters in either case are ASCII letters only.
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE,
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
# Cheap tests that every text with a pattern's match passes.
MAY_ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']? *[:=]"""
MAY_HEX = byte_set(b"0123456789abcdef")
KEY_CHARS = byte_set(bytes([*range(48, 58), *range(65, 91), *range(97, 123)]) + b"+/_=-")
# Digests by their length in hex digits (MD5 to SHA-512), UUIDs, and plain numbers.
DIGEST = re.compile(rb"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.I)
IDENTIFIER = re.compile(rb"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9+/_=-]+", re.I)
# Letters in the cases of an ordinary word.
WORD = re.compile(rb"[A-Za-z]?[a-z]+|[A-Z]+")
# Fixed value: how the vocabulary's makers split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class TokenEfficiency:
    """``ratio``: most characters per token of a random string; ``min_chars``: its least length.

    ``word_ratio`` is the ratio for letters in the cases of a word: words of rare languages
    need more tokens than others, but fewer than random letters.
    """

    vocabulary: str
    ratio: float = 2.2
    min_chars: int = 16
    word_ratio: float = 1.85


_vocabularies: dict[str, object] = {}


def vocabulary(path: str):
    """The worker's encoding of a rank file."""
    if path not in _vocabularies:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _vocabularies[path] = tiktoken.Encoding(
            "ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}
        )
    return _vocabularies[path]


Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: bytes, assign: bool = True, access: bool = True, hexes: bool = True) -> list[Span]:
    """Matches of the fixed patterns, in bytes."""
    found = []
    if assign:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if access:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if hexes:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(found)


def is_random(run: bytes, rule: TokenEfficiency) -> bool:
    """The token-efficiency test of one run of key-like characters."""
    if DIGEST.fullmatch(run) or IDENTIFIER.fullmatch(run):
        return False
    ratio = rule.word_ratio if WORD.fullmatch(run) else rule.ratio
    return len(run) <= ratio * len(vocabulary(rule.vocabulary).encode_ordinary(run.decode()))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, rule: TokenEfficiency) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row.

    ``spans`` lists ``kind:start:end`` in code points, end exclusive, by start and then
    kind; ``base_sha256`` is the digest of the list of the fixed patterns' spans. Kind
    ``random`` is added by the token-efficiency test for runs that touch no other span. Null and empty texts have no spans; repeated rows are scanned alike; an
    empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            column = batch.column("text")
            may_assign = pc.match_substring_regex(column, MAY_ASSIGN).to_numpy(zero_copy_only=False)
            may_access = pc.match_substring(column, "AKIA").to_numpy(zero_copy_only=False)
            starts, ends, owners = texts.runs(MAY_HEX)
            may_hex = np.zeros(texts.size, bool)
            may_hex[owners[ends - starts >= 24]] = True
            starts, ends, owners = texts.runs(KEY_CHARS)
            long = ends - starts >= rule.min_chars
            starts, ends, owners = starts[long], ends[long], owners[long]
            runs: dict[int, list[tuple[int, int]]] = {}
            for a, b, doc in zip(starts.tolist(), ends.tolist(), owners.tolist(), strict=True):
                low = int(texts.offsets[doc])
                runs.setdefault(doc, []).append((a - low, b - low))
            busy = np.flatnonzero(may_assign | may_access | may_hex)
            found: dict[int, tuple[list[Span], list[Span]]] = {}
            points = texts.code_points()
            for doc in sorted({*busy.tolist(), *runs}):
                low = int(texts.offsets[doc])
                text = texts.data[low : texts.offsets[doc + 1]].tobytes()
                base = base_spans(text, may_assign[doc], may_access[doc], may_hex[doc])
                more = [
                    (a, 3, b)
                    for a, b in runs.get(doc, ())
                    if not any(x < b and a < y for x, _, y in base) and is_random(text[a:b], rule)
                ]

                def placed(spans, low=low):
                    return [
                        (int(points[low + a] - points[low]), k, int(points[low + b] - points[low]))
                        for a, k, b in spans
                    ]

                found[doc] = placed(base), placed(sorted(base + more))
            none: tuple[list, list] = ([], [])
            rows = [found.get(i, none) for i in range(texts.size)]
            counts = [[sum(k == kind for _, k, _ in base) for base, _ in rows] for kind in range(3)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *[pa.array(c, pa.int64()) for c in counts],
                    pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in rows], pa.string()),
                    pa.array([_joined(spans) for _, spans in rows], pa.string()),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return source.mapInArrow(
        run,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )

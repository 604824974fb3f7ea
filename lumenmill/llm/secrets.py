"""Secret scans (operator 9): fixed patterns, and a token-efficiency test for random strings.

Text made of words needs few tokens for its characters; random strings need many. Runs of key characters whose
characters-per-token ratio under a byte-level BPE vocabulary is low are reported, after known digests (md5, sha1, sha256,
sha512 in hexadecimal), UUIDs, and identifiers (words, numbers, paths, snake_case and camelCase names) are excluded.
A stretch of letters of one case counts as a word only up to a length that words have; a longer one goes through the test.
Every step is linear in the text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenmill.llm.common import text_of

# The base patterns, in the order in which their kinds are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
# Fixed values end.

_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
# A maximal run that is long enough: the same as dropping short matches of the base pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_HEX_ONLY = re.compile(r"[0-9a-fA-F]+")
_DIGESTS = (32, 40, 56, 64, 96, 128)
# Names of words with a number at their end; each word begins with a capital or behind a sign, so there is one way to match.
_NAME = re.compile(r"(?:[a-z]{2,15}|[A-Z][a-z]{1,15})(?:[A-Z][a-z]{1,15})*[0-9]*|[A-Z]{2,15}[0-9]*|[0-9]+")

OUT = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, n_judged long, base_sha256 string, spans string"


@lru_cache(maxsize=4)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_known(run: str) -> bool:
    """A digest, a UUID, or an identifier: no letter, or made of words and numbers throughout."""
    if _UUID.fullmatch(run) or len(run) in _DIGESTS and _HEX_ONLY.fullmatch(run):
        return True
    if not re.search("[A-Za-z]", run):
        return True
    return all(_NAME.fullmatch(p) for p in re.split("[+/_=-]", run) if p)


def candidate_runs(text: str, base: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs that are not known and overlap none of the base spans (start, end), which are sorted; whatever stands beside them, such as letters of a script without spaces."""
    at, upto = 0, 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        while at < len(base) and base[at][0] < b:
            upto = max(upto, base[at][1])
            at += 1
        if upto > a or is_known(m[0]):
            continue
        yield a, b


def spans_of(text: str, encoding, ratio: float) -> tuple[list[tuple[int, int, int]], int]:
    """(start, rank of kind, end), sorted, and how many runs the token-efficiency test has judged; a run that overlaps a base span is not judged."""
    found = []
    low = text.encode("utf-8", "replace").lower()
    if any(word in low for word in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    judged = list(candidate_runs(text, sorted((a, b) for a, _, b in found)))
    found += [(a, 3, b) for a, b in judged if b - a < ratio * tokens_in(text[a:b], encoding)]
    return sorted(found), len(judged)


def tokens_in(run: str, encoding) -> int:
    """Tokens of a run. A run can be as long as a text, and merging one long piece takes the square of its length, so it is cut into pieces of 1,000 characters."""
    return sum(len(encoding.encode_ordinary(run[at : at + 1000])) for at in range(0, len(run), 1000))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, vocabulary: str, ratio: float = 2.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the id, a count for each kind, the runs that the token test judged, the digest of the base spans, and all spans in text.

    Null text counts as empty; a document without spans has counts 0, spans '' and the digest of ''. Spans are in code points,
    end exclusive, by start and then kind. Repeated rows and rows without an id are scanned like others; other columns are not read. vocabulary: path of a tiktoken rank file, which every worker can read.
    ratio: characters per token under which a run counts as random. Every row is scanned where it lies, whole and alone; no shuffle.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                spans, judged = spans_of(text, encoding, ratio)
                count = [0, 0, 0, 0]
                for _, k, _ in spans:
                    count[k] += 1
                digest = hashlib.sha256(_joined([s for s in spans if s[1] < 3]).encode()).hexdigest()
                rows.append((*count, judged, digest, _joined(spans)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            arrays = [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:5]], *[pa.array(c, pa.string()) for c in columns[5:]]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "n_judged", "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(scan, OUT).withColumnRenamed("doc_id", id_col)

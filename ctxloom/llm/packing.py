"""Order-preserving packing of token streams into fixed windows.

Documents keep their order within a partition of the input and form one stream of ids.  The stream is cut at document
ends (free), at sentence ends (SENTENCE) or, every EVERY ids of a longer sentence, inside it (HARD), so that
padding plus these truncation penalties is least.  With f[j] the least cost of the stream up to boundary j,
f[j] = min over i within a window of f[i] + size - (pos[j] - pos[i]) + penalty[j]; f[i] + pos[i] does not depend on j,
so a monotone queue gives each minimum in constant amortised time.  The programme runs over blocks of BLOCK ids; the
last window of a block begins the next one.  A partition's last window is cut in powers of two, which need no padding.

Nothing is shuffled: sequences never span partitions, and the windows of a partition depend on its rows alone, so a
task that is run again gives the same rows.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm.common import table

SIZE = 2048
SENTENCE, HARD = 4.0, 12.0
EVERY = 16
BLOCK = 1 << 20
#: Words whose ids a worker keeps at least.
CACHE = 400_000
END_ID = 1


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Ids(dict):
    """Ids, as little-endian bytes, of a word with the space before it.  Two generations bound its memory."""

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = None if word != word.strip() or not word or "<|" in word else self.encode(" " + word)
            if found is None:
                raise LookupError(word)
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


# Fixed value: the pattern by which byte-level tokenizers of this kind split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts by the tokenizer, word by word: with a byte-level vocabulary a single space between two words
    always begins a token, so words may be encoded apart and remembered.  Where ids are also the order of merges, as
    ranks, a word's ids come from those ranks, which is the same and quicker.  Texts with other white space at a word's
    edge, or with what may be a special token, are encoded whole, as are all of a tokenizer of another kind."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        before, model = kind.get("pre_tokenizer") or {}, kind["model"]
        self.by_word = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not kind.get("normalizer")
        self.words = _Ids(self._ranked(model) if self.by_word and self._in_order(model) else self.whole)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([bool(s) and (s.rstrip("\"')]").endswith((".", "!", "?")) or "Ċ" in s) for s in ((self.tokenizer.id_to_token(i) or "") for i in range(size))])

    @staticmethod
    def _in_order(model: dict) -> bool:
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", [])]
        return model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and all(model["vocab"].get(m) == 256 + i for i, m in enumerate(merged))

    @staticmethod
    def _ranked(model: dict):
        import tiktoken

        byte = _byte_of()
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(model["merges"]) and all(c in byte for c in token)}
        encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda text: array("I", encode(text)).tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        first, _, rest = text.partition(" ")
        try:
            if not self.by_word or not rest or first != first.strip() or "<|" in text:
                return self.whole(text)
            return self.whole(first) + b"".join(map(self.words.__getitem__, rest.split(" ")))
        except LookupError:
            return self.whole(text)


def cuts(pos: list[int], penalty: list[float], size: int) -> list[int]:
    """Places in pos where windows end.  Less than a window is left after the last one, as its padding isn't counted:
    it begins the next block or is cut in powers of two.  Neighbours in pos lie at most size apart."""
    n = len(pos)
    back, least = [0] * n, [0.0] * n
    least[0] = float(pos[0])
    queue = deque([0])
    for j in range(1, n):
        p = pos[j]
        while pos[queue[0]] < p - size:
            queue.popleft()
        i = queue[0]
        back[j] = i
        cost = least[j] = least[i] + size + penalty[j]
        while queue and least[queue[-1]] > cost:
            queue.pop()
        queue.append(j)
    j, found = n - 1, []
    for i in range(n - 1, -1, -1):
        if pos[i] < pos[-1] - size:
            break
        if least[i] - pos[i] < least[j] - pos[j]:
            j = i
    while j > 0:
        found.append(pos[j])
        j = back[j]
    return found[::-1]


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[float]]:
    penalty = np.full(len(ids) + 1, np.inf)
    penalty[np.flatnonzero(ends[np.minimum(ids, len(ends) - 1)]) + 1] = SENTENCE
    penalty[doc_ends] = 0
    penalty[[0, len(ids)]] = 0
    pos = np.flatnonzero(np.isfinite(penalty))
    steps = (np.diff(pos) - 1) // EVERY
    inner = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps) + 1
    penalty[np.repeat(pos[:-1], steps) + EVERY * inner] = HARD
    pos = np.flatnonzero(np.isfinite(penalty))
    return pos.tolist(), penalty[pos].tolist()


class Packer:
    """Takes documents in order and gives the pieces of finished sequences."""

    def __init__(self, ends: np.ndarray, size: int, first: int):
        self.ends, self.size, self.sequence = ends, size, first
        self.segments: list[tuple] = []  # document, its ids before, its ids, bytes
        self.held = 0

    def add(self, doc, ids: bytes) -> list[tuple]:
        total, out = len(ids) // 4, []
        for at in range(0, total, BLOCK):
            part = ids[4 * at : 4 * (at + BLOCK)]
            self.segments.append((doc, at, total, part))
            self.held += len(part) // 4
            if self.held >= BLOCK:
                out += self.flush(False)
        return out

    def flush(self, last: bool) -> list[tuple]:
        if not self.segments:
            return []
        stream = b"".join(s[3] for s in self.segments)
        ids = np.frombuffer(stream, "<u4")
        bounds = np.cumsum([len(s[3]) // 4 for s in self.segments])
        whole = np.array([s[1] + len(s[3]) // 4 == s[2] for s in self.segments])
        ends = cuts(*boundaries(ids, bounds[whole], self.ends), self.size)
        if last:
            at = ends[-1] if ends else 0
            left = len(ids) - at
            while left:
                step = self.size if left >= self.size else 1 << (left.bit_length() - 1)
                at, left = at + step, left - step
                ends.append(at)
        out, k, low = [], 0, 0
        for end in ends:
            begin = low
            while low < end:
                doc, before, total, part = self.segments[k]
                own = int(bounds[k]) - len(part) // 4
                stop = min(end, int(bounds[k]))
                out.append((doc, before + low - own, stop - low, zlib.crc32(stream[4 * low : 4 * stop]), total, self.sequence, low - begin))
                low = stop
                k += low == bounds[k]
            self.sequence += 1
        rest = []
        if not last:
            for j in range(k, len(self.segments)):
                doc, before, total, part = self.segments[j]
                own = int(bounds[j]) - len(part) // 4
                skip = max(0, low - own)
                rest.append((doc, before + skip, total, part[4 * skip :]))
        self.segments, self.held = rest, sum(len(s[3]) // 4 for s in rest)
        return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """One row per piece.  A null or empty text is its end id alone; equal rows and equal doc_ids are packed each; no
    rows give no rows.  path: the tokenizer's file."""
    path = path or tokenizer_path()

    def run(batches):
        encoder = Encoder(path)
        packer = Packer(encoder.ends, size, TaskContext.get().partitionId() << 33)
        end = np.array([END_ID], "<u4").tobytes()
        schema = pa.schema([(name, pa.int64()) for name in (x.split()[0] for x in PIECES.split(", "))])

        def rows(pieces):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*pieces) if pieces else [[]] * 7)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if pieces := packer.add(doc_id, (encoder(text) if text else b"") + end):
                    yield rows(pieces)
        yield rows(packer.flush(True))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

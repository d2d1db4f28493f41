"""BPE encoding and decoding of whole texts from a tokenizers JSON file.

The leftmost merge of least rank is the root of a segment tree over the ranks of adjacent
pairs; a merge changes three leaves, each updated in logarithmic time.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose encoding a Python worker remembers.
REMEMBERED = 300_000
_FAR = 1 << 60


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return out


def merge_word(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """symbols after all merges: again and again the pair of least rank, the leftmost first.

    ranks: pair of symbols to (rank, merged symbol). Nodes hold rank * length + position, so the
    minimum at the root is the leftmost lowest rank; absent pairs are far.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [_FAR] * (2 * size)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    for i in range(n - 1):
        if found := ranks.get((symbols[i], symbols[i + 1])):
            tree[size + i] = found[0] * n + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                break
            tree[i] = low

    while (root := tree[1]) < _FAR:
        i = root % n
        j = after[i]
        symbols[i] = ranks[symbols[i], symbols[j]][1]
        k = after[i] = after[j]
        symbols[j] = -1
        if j < n - 1:
            put(j, _FAR)
        if k < n:
            before[k] = i
            found = ranks.get((symbols[i], symbols[k]))
            put(i, found[0] * n + i if found else _FAR)
        else:
            put(i, _FAR)
        if (h := before[i]) >= 0:
            found = ranks.get((symbols[h], symbols[i]))
            put(h, found[0] * n + h if found else _FAR)
    return [s for s in symbols if s >= 0]


class WordBpe:
    """The encoder of a tokenizers JSON with NFC, lower case, a split pattern and byte-level BPE with word ends."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        vocab = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.ranks = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.ranks.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        symbols = byte_symbols()
        self.inner = [vocab.get(s) for s in symbols]
        self.last = [vocab.get(s + self.end) for s in symbols]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # White space is Unicode's property here; Python's \s also takes the separators 1C to 1F.
        self.words = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}"), regex.V0)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, tuple[str, str]] = {}

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        return merge_word([i for i in ids if i is not None], self.ranks)

    def decode(self, ids: list[int]) -> str:
        """As decode(ids, skip_special_tokens=False) of a tokenizer without a decoder: tokens joined by spaces."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)

    def remembered(self, word: str) -> tuple[str, str]:
        """The word's ids and the text they decode to, each joined by spaces."""
        ids = self.encode_word(word)
        pair = " ".join(map(str, ids)), self.decode(ids)
        if len(word) <= 40 and len(self.known) < REMEMBERED:
            self.known[word] = pair
        return pair

    def segment(self, text: str) -> list[tuple[str, str]]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # A capital sigma becomes the final form only in whole-string lower case.
        text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
        known, slow = self.known, self.remembered
        return [known.get(w) or slow(w) for w in self.words.findall(text)]

    def encode_text(self, text: str) -> tuple[str, str]:
        """The text's ids joined by spaces, and the text decoded from them."""
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        parts, at = [], 0
        if self.split:
            for m in self.split.finditer(text) if "<|" in text or not all(s.startswith("<|") for s in self.special) else ():
                parts += self.segment(text[at : m.start()])
                parts.append((str(self.special[m.group()]), m.group()))
                at = m.end()
        parts += self.segment(text[at:] if at else text)
        return " ".join([p[0] for p in parts if p[0]]), " ".join([p[1] for p in parts if p[0]])


_ENCODERS: dict[str, WordBpe] = {}


def encoder(spec: str) -> WordBpe:
    """The encoder of a tokenizer file's content, built once in a Python worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = WordBpe(json.loads(spec))
    return _ENCODERS[key]


def _encode(spec, full: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(spec.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                done = [bpe.encode_text(t.as_py() or "") for t in batch.column(1)]
                columns = [
                    batch.column(0),
                    pa.array([ids.count(" ") + 1 if ids else 0 for ids, _ in done], pa.int64()),
                    pa.array([hashlib.sha256(ids.encode()).hexdigest() for ids, _ in done]),
                    pa.array([hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest() for _, text in done]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if full:
                    columns += [pa.array([[*map(int, ids.split())] for ids, _ in done], pa.list_(pa.int32())), pa.array([text for _, text in done])]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of each row of docs.

    The driver reads tokenizer_path once and broadcasts its content (a file of a few MB), so
    executors need no copy. A null or empty text has no tokens; ids are passed through, null
    or repeated. Texts are encoded whole and a batch of 256 at a time.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encode(spec, full), schema)

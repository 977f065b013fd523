"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

The library's model works on characters, one for each byte: a fixed byte-to-character table.  A rank file holds no merge
list, so each token's merge is recovered by replaying the merges below its own rank.  Decoding reverses the byte table;
a character split over tokens comes back whole, since bytes are joined before they are read as UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import give_back, read, ship

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Texts in one call of the library, and code points: a batch ends at either, so memory follows the longest text alone.
BATCH_TEXTS, BATCH_POINTS = 256, 1 << 20


@lru_cache(maxsize=1)
def byte_table() -> dict[int, str]:
    """Byte -> character: printable Latin-1 bytes stand for themselves, the others for the code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _last_merge(token: bytes, rank: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that are left once every merge below the token's own rank is done."""
    parts, own = [token[i : i + 1] for i in range(len(token))], rank[token]
    while len(parts) > 2:
        best = min(((rank.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(own, 0))
        if best[0] >= own:
            return None
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def tokenizer_json(rank: dict[bytes, int], pattern: str) -> str:
    """The library's own description of the tokenizer."""
    table = byte_table()
    text = lambda token: "".join(map(table.__getitem__, token))
    merges = [m for token in sorted(rank, key=rank.get) if len(token) > 1 and (m := _last_merge(token, rank))]
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None, "decoder": None,
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        ]},
        "model": {
            "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False,
            "ignore_merges": True, "vocab": {text(t): r for t, r in rank.items()}, "merges": [[text(a), text(b)] for a, b in merges],
        },
    })


class Codec:
    """Encoder and decoder for one vocabulary; built once in each worker.

    Texts are cut into the pattern's matches; a match goes through the library's model, which gives its tokens.  Matches
    of SHORT characters at most are remembered (up to KEPT; then the memory starts afresh), since merges never cross a
    match; so the memory is bounded in bytes.
    """

    KEPT, SHORT = 1 << 17, 64

    def __init__(self, description: str):
        import regex
        from tokenizers import Tokenizer

        self.cut = regex.compile(json.loads(description)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.model = Tokenizer.from_str(description).model
        self.to_chars = {b: c for b, c in byte_table().items() if chr(b) != c}
        back = {c: b for b, c in byte_table().items()}
        vocabulary = json.loads(description)["model"]["vocab"]
        self.bytes_of: list[bytes] = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        self.names = [str(i).encode() for i in range(len(self.bytes_of))]
        self.known: dict[str, tuple[int, ...]] = {}

    def match_ids(self, match: str) -> tuple[int, ...]:
        """The library's merges over one match of the pattern, its bytes as characters."""
        chars = match.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_chars)
        return tuple([t.id for t in self.model.tokenize(chars)])

    def _pieces(self, text: str) -> tuple[list[str], dict[str, tuple[int, ...]]]:
        """The text's matches, and ids of all of them."""
        pieces = self.cut.findall(text)
        new = set(pieces).difference(self.known)
        if not new:
            return pieces, self.known
        if len(self.known) > self.KEPT:
            self.known.clear()
            new = set(pieces)
        long = {p: self.match_ids(p) for p in new if len(p) > self.SHORT}
        self.known.update((p, self.match_ids(p)) for p in new if len(p) <= self.SHORT)
        return pieces, {p: self.known[p] if p in self.known else long[p] for p in set(pieces)} if long else self.known

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            pieces, ids = self._pieces(text)
            out.append(list(chain.from_iterable(map(ids.__getitem__, pieces))))
        return out

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: ids, the listed ids' SHA-256, the SHA-256 of what the list of ids decodes to.  Repeated texts of a batch are done once."""
        done: dict[str, tuple[int, str, str]] = {}
        for text in texts:
            if text not in done:
                ids = self.encode([text])[0]
                listed = b" ".join(map(self.names.__getitem__, ids))
                done[text] = (len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(self.decode_bytes(ids)).hexdigest())
        return [done[t] for t in texts]

    def encode_with_offsets(self, texts: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        """Ids and, for each, the code points that it touches, end exclusive; a code point split over tokens belongs to each."""
        out = []
        for text, ids in zip(texts, self.encode(texts)):
            at = [k for k, c in enumerate(text) for _ in range(len(c.encode("utf-8", "surrogatepass")))]
            spans, first = [], 0
            for i in ids:
                after = first + len(self.bytes_of[i])
                spans.append((at[first], at[after - 1] + 1))
                first = after
            out.append((ids, spans))
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text; bytes that form no character, as when a list of ids is cut inside one, become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(description: str) -> Codec:
    key = hashlib.sha256(description.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(description)
    return _codecs[key]


def default_description(path: str | None = None, pattern: str | None = None) -> str:
    import public_tokenizers

    out = tokenizer_json(ranks(path or public_tokenizers.path(VOCABULARY)), pattern or public_tokenizers.PATTERN)
    give_back()
    return out


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = points = 0
    for i, t in enumerate(texts):
        points += len(t)
        if i + 1 - start >= BATCH_TEXTS or points >= BATCH_POINTS:
            yield start, i + 1
            start, points = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def map_texts(docs: DataFrame, id_col: str, text_col: str, fields: list[tuple[str, pa.DataType]], ddl: str, work: Callable[[Codec, list[str]], list[tuple]], description: str) -> DataFrame:
    """docs' ids beside what work() makes of each text, in Arrow batches; the vocabulary is broadcast once."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(description)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = codec(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _groups(texts):
                rows = work(own, texts[a:b])
                arrays = [pa.array([r[i] for r in rows], type=t) for i, (_, t) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *arrays], ["doc_id", *(n for n, _ in fields)])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {ddl}")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", description: str | None = None) -> DataFrame:
    """doc_id, ids, starts, ends: token ids and the code points that each touches.

    Null texts count as empty and give empty arrays; repeated rows give a row each; an empty table gives none.
    """
    def work(own: Codec, texts: list[str]) -> list[tuple]:
        return [(ids, [a for a, _ in spans], [b for _, b in spans]) for ids, spans in own.encode_with_offsets(texts)]

    ints = pa.list_(pa.int32())
    return map_texts(docs, id_col, text_col, [("ids", ints), ("starts", ints), ("ends", ints)], "ids array<int>, starts array<int>, ends array<int>", work, description or default_description())


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", description: str | None = None) -> DataFrame:
    """doc_id, bytes, text: what the ids stand for; null ids count as none.  An id outside the vocabulary is an error."""
    ship(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(description or default_description())
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            raw = [own.decode_bytes(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())], ["doc_id", "bytes", "text"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, bytes binary, text string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", description: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes every whole text, decodes the ids, and digests both.

    Null and empty texts have no ids (the digests are those of the empty string); repeated rows give a row each; texts may be
    of any length; other columns play no part; an empty table gives no rows.
    """
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return map_texts(docs, id_col, text_col, fields, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", Codec.digests, description or default_description())


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))

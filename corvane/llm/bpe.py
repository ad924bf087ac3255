"""Operator 10: BPE encoding and decoding with tree concatenation, equal to the tokenizers library's results.

Words (between ASCII white space) up to LONG_WORD bytes are encoded by the library and remembered: white space is dropped
by the tokenizer and no pre-token spans it, so a text's ids are those of its words in turn. Longer unsplit text goes
through the tree: it is normalised, cut into leaves anywhere, leaves are encoded on their own, and neighbours are
joined. A join re-encodes a window around the seam that grows until its first and last pieces are those that both sides
had; outside it nothing can change. Pre-tokens are joined first, then, inside a pre-token that spans the seam, BPE tokens.

Texts over PART_CHARS code points are cut into parts that are encoded as rows of their own, in parallel on the cluster,
and joined per document. Null text is the empty text: no ids, and it decodes to the empty string.
"""

from __future__ import annotations

import gc
import hashlib
import re
import uuid
from array import array
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import documents, extended, lean

LONG_WORD = 4096
LEAF_CHARS = 128
PART_CHARS = 1 << 18
CACHE_BYTES = 192 << 20
END = "</w>"
#: ASCII letters and the bytes of U+00C0 to U+017F: letters there are single code points in composed and in lower-case form, in
#: every version of Unicode.
LATIN = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5])
#: A run of these is one pre-token, whatever it follows.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words that a worker remembers from task to task; more go when a task ends.
KEPT_WORDS = 500_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100 on in turn."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(0x100 + k) for k, b in enumerate(others)}


class Cache(dict):
    """Words and what ``make`` gives for them; held counts its bytes, roughly."""

    def __init__(self, make):
        self.make, self.held = make, 0

    def __missing__(self, key: bytes) -> bytes:
        self.held += len(key) + 150
        out = self[key] = self.make(key)
        return out


def same_ends(part: list, left: list, right: list) -> tuple[bool, bool]:
    return bool(part and left) and part[0] == left[0], bool(part and right) and part[-1] == right[-1]


class Encoder:
    """Exact ids for whole texts. The cache of words is bounded and dropped when full."""

    def __init__(self, path: str, long_word: int = LONG_WORD, leaf: int = LEAF_CHARS):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.long_word, self.leaf = long_word, leaf
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.specials = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)))
        self.vocab = spec["model"]["vocab"]
        self.ranks = {tuple(x) if isinstance(x, list) else tuple(x.split(" ")): i for i, x in enumerate(spec["model"]["merges"])}
        self.token = {i: t for t, i in chain(self.vocab.items(), self.special.items())}
        self.size = max(self.token) + 1
        self.type = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.tokens = [self.token.get(i, "") for i in range(self.size)]
        self.code = "H" if self.type is np.uint16 else "I"
        self.model = self.lib.model
        self.byte_letters = byte_letters()
        self.tails = Cache(lambda x: self.pack(self.lib.encode(x.decode(), add_special_tokens=False).ids))
        self.cache = Cache(self.word)
        self.pieces: dict[str, list[str]] = {}

    def pack(self, ids) -> bytes:
        return np.array(ids, self.type).tobytes()

    # whole texts

    def encode_batch(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Ids of each text."""
        if self.cache.held > CACHE_BYTES:
            self.forget()
        get = self.cache.__getitem__
        gc.disable()  # millions of small objects, none in a cycle
        try:
            return [np.frombuffer(b"".join(map(get, (x or b"").split())), self.type) for x in texts]
        finally:
            gc.enable()

    def forget(self) -> None:
        """Keeps the words learnt first, which are the frequent ones."""
        for cache in (self.cache, self.tails):
            kept = dict(islice(cache.items(), KEPT_WORDS))
            cache.clear()
            cache.update(kept)
            cache.held = sum(len(k) + 150 for k in kept)

    def word(self, raw: bytes) -> bytes:
        """Packed ids of one word."""
        if len(raw) > self.long_word:
            return self.pack(self.unsplit(raw.decode("utf-8", "replace")))
        # Most words are Latin letters, perhaps with marks after them: one or two pre-tokens, already composed.
        core = raw.rstrip(MARKS)
        tail = self.tails[raw[len(core) :]] if len(core) < len(raw) else b""
        if core.isalpha():  # of bytes: A-Z and a-z only
            small = core.lower()
            if small != raw:  # its ids may be known, and are from now on
                return self.cache[small] + tail
            return array(self.code, [t.id for t in self.model.tokenize(small.decode())]).tobytes()
        text = "" if core.translate(None, LATIN) else core.decode("utf-8", "replace")
        small = text.lower()
        if small.isalpha() and len(small) == len(text):
            return array(self.code, [t.id for t in self.model.tokenize(small.encode().decode("latin-1").translate(self.byte_letters))]).tobytes() + tail
        return self.pack(self.lib.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def parts(self, text: str):
        """(special id or None, normalised text) in turn: special tokens are found before anything else, the leftmost first."""
        at = 0
        for found in self.specials.finditer(text) if self.special else ():
            if found.start() > at:
                yield None, self.lib.normalizer.normalize_str(text[at : found.start()])
            yield self.special[found[0]], ""
            at = found.end()
        if at < len(text):
            yield None, self.lib.normalizer.normalize_str(text[at:])

    def unsplit(self, text: str) -> list[int]:
        out: list[int] = []
        for special, part in self.parts(text):
            out += [special] if special is not None else self.ids(self.tree(part))
        return out

    # the tree; a segment is (text, [(start, end, tokens)])

    def tree(self, text: str):
        segments = [self.segment(text[i : i + self.leaf]) for i in range(0, len(text), self.leaf)] or [("", [])]
        while len(segments) > 1:
            segments = [self.join(*segments[i : i + 2]) if i + 1 < len(segments) else segments[i] for i in range(0, len(segments), 2)]
        return segments[0]

    def ids(self, segment) -> list[int]:
        return [self.vocab[t] for _, _, tokens in segment[1] for t in tokens]

    def pretokens(self, text: str):
        return self.lib.pre_tokenizer.pre_tokenize_str(text)

    def segment(self, text: str):
        return text, [(a, b, self.piece(p)) for p, (a, b) in self.pretokens(text)]

    def piece(self, p: str) -> list[str]:
        """Tokens of a whole pre-token; those of short ones are remembered."""
        if p not in self.pieces:
            tokens = self.bpe([*p[:-1], p[-1] + END])
            if len(p) > 32:
                return tokens
            if len(self.pieces) > 200_000:
                self.pieces.clear()
            self.pieces[p] = tokens
        return self.pieces[p]

    def bpe(self, symbols: list[str]) -> list[str]:
        """Merges the pair of the lowest rank, leftmost first, until none is left."""
        out = list(symbols)
        while len(out) > 1:
            pairs = list(zip(out, out[1:]))
            best = min(pairs, key=lambda p: self.ranks.get(p, 1 << 60))
            if best not in self.ranks:
                break
            merged, i = [], 0
            while i < len(out):
                if i + 1 < len(out) and (out[i], out[i + 1]) == best:
                    merged.append(out[i] + out[i + 1])
                    i += 2
                else:
                    merged.append(out[i])
                    i += 1
            out = merged
        return out

    @staticmethod
    def symbols(token: str, last: bool) -> list[str]:
        """Single symbols of a token, without the end mark unless the token ends a pre-token."""
        bare = token.removesuffix(END)
        return [*bare[:-1], bare[-1] + END] if last and bare != token else list(bare)

    def join(self, left, right):
        (a, lp), (b, rp) = left, right
        text, shift = a + b, len(a)
        k = 1
        while True:
            lk, rk = min(k, len(lp)), min(k, len(rp))
            start = lp[-lk][0] if lk and lk < len(lp) else 0
            stop = shift + rp[rk - 1][1] if rk and rk < len(rp) else len(text)
            window = [(x + start, y + start, p) for p, (x, y) in self.pretokens(text[start:stop])]
            # The pieces at both rims must be those that the sides had, or the rims must be the ends of the text.
            first = window and (window[0][0], window[0][1]) == lp[-lk][:2] if lk and lk < len(lp) else True
            last = window and (window[-1][0] - shift, window[-1][1] - shift) == rp[rk - 1][:2] if rk and rk < len(rp) else True
            if first and last:
                break
            k *= 2
        known = {(x, y): t for x, y, t in lp[len(lp) - lk :]} | {(x + shift, y + shift): t for x, y, t in rp[:rk]}
        heads, tails = {x: t for x, y, t in lp[len(lp) - lk :] if y == shift}, {y + shift: t for x, y, t in rp[:rk] if x == 0}
        middle = []
        for x, y, p in window:
            if (x, y) in known:
                tokens = known[x, y]
            elif x < shift < y and x in heads and y in tails:
                tokens = self.join_tokens(heads[x], tails[y])
            else:
                tokens = self.piece(p)
            middle.append((x, y, tokens))
        return text, [*lp[: len(lp) - lk], *middle, *((x + shift, y + shift, t) for x, y, t in rp[rk:])]

    def join_tokens(self, left: list[str], right: list[str]) -> list[str]:
        """Of one pre-token's halves; left was encoded as if it ended there."""
        k = 2
        while True:
            lk, rk = min(k, len(left)), min(k, len(right))
            symbols = [s for t in left[len(left) - lk :] for s in self.symbols(t, False)]
            symbols += [s for i, t in enumerate(right[:rk]) for s in self.symbols(t, i + 1 == len(right))]
            window = self.bpe(symbols)
            first, last = same_ends(window, left[len(left) - lk :], right[:rk])
            if (first or lk == len(left)) and (last or rk == len(right)):
                return [*left[: len(left) - lk], *window, *right[rk:]]
            k *= 2

    def decode(self, ids: np.ndarray) -> str:
        """As the library without a decoder: the tokens with a space between."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(texts: list[bytes | None], most: int = 4 << 20):
    """Ranges of texts of a few MB each, so that what is made of them stays small."""
    start = held = 0
    for i, x in enumerate(texts):
        if i > start and held + len(x or b"") > most:
            yield start, i
            start, held = i, 0
        held += len(x or b"")
    if start < len(texts):
        yield start, len(texts)


def map_ids(docs: DataFrame, schema, make, path: str | None = None) -> DataFrame:
    """docs in rows of ``schema``: make(encoder, ids of each text) gives the columns that docs lacks, as Arrow arrays.

    make(encoder, list of id arrays) -> list of arrays, in the order of the schema after docs' own columns.
    """
    path = path or tokenizer_path()

    @lean
    def run(batches):
        coder = encoder(path)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = as_bytes(batch.column(at))
            for a, b in slices(texts):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *make(coder, coder.encode_batch(texts[a:b]))], names=schema.names)
        coder.forget()

    return docs.mapInArrow(run, schema)


def _part_rows(docs: DataFrame, path: str, part_chars: int) -> DataFrame:
    """Parts of long texts: (row_key, part, special, text); normalised as wholes, cut anywhere."""

    @lean
    def run(batches):
        coder = encoder(path)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = 0
                for special, chunk in coder.parts(text):
                    for i in range(0, max(1, len(chunk)), part_chars):
                        yield pa.RecordBatch.from_pydict({"row_key": [key], "part": pa.array([part], pa.int32()), "special": pa.array([special], pa.int32()), "chunk": [chunk[i : i + part_chars]]})
                        part += 1

    return docs.select("row_key", "text").mapInArrow(run, "row_key string, part int, special int, chunk string")


def _encode_parts(parts: DataFrame, path: str) -> DataFrame:
    @lean
    def run(batches):
        import pickle

        coder = encoder(path)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                special, chunk = row.column(2)[0].as_py(), row.column(3)[0].as_py()
                segment = pickle.dumps(coder.tree(chunk) if special is None else special, 5)
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), pa.array([segment], pa.binary())], names=["row_key", "part", "segment"])

    return parts.mapInArrow(run, "row_key string, part int, segment binary")


def _join_parts(path: str):
    def run(table: pa.Table) -> pa.Table:
        import pickle

        coder = encoder(path)
        table = table.sort_by("part")
        out: list[int] = []
        level: list = []

        def flush():
            nonlocal level
            while len(level) > 1:
                level = [coder.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            out.extend(x for s in level for x in coder.ids(s))
            level = []

        for raw in table["segment"].to_pylist():
            segment = pickle.loads(raw)
            if isinstance(segment, int):
                flush()
                out.append(segment)
            else:
                level.append(segment)
        flush()
        return pa.table({"row_key": table["row_key"][:1], "packed": pa.array([coder.pack(out)], pa.binary())})

    return run


def encode(docs: DataFrame, path: str | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """docs with ids (array<int>) and decoded (string); clashing columns are replaced."""
    path = path or tokenizer_path()
    docs = docs.drop("ids", "decoded")
    schema = extended(docs, ids="array<int>", decoded="string")

    def make(coder, all_ids):
        return [pa.array([x.astype(np.int32) for x in all_ids], pa.list_(pa.int32())), pa.array([coder.decode(x) for x in all_ids], pa.string())]

    def long_columns(coder, raw):
        return make(coder, [np.frombuffer(x, coder.type) for x in raw])

    return _both(docs, schema, make, long_columns, path, part_chars)


def _both(docs: DataFrame, schema, make, make_long, path: str, part_chars: int) -> DataFrame:
    """Short texts row by row, texts over part_chars by parts and the tree; rows with the same id and text are alike."""
    is_long = F.coalesce(F.length("text"), F.lit(0)) > part_chars
    short = map_ids(docs.filter(~is_long), schema, make, path)
    key, held = f"row_key_{uuid.uuid4().hex}", f"packed_{uuid.uuid4().hex}"  # no column of docs has these names
    long_docs = docs.filter(is_long).withColumn(key, F.sha2("text", 256))
    parts = _part_rows(long_docs.select(F.col(key).alias("row_key"), "text").dropDuplicates(["row_key"]), path, part_chars).repartition("row_key", "part")
    joined = _encode_parts(parts, path).groupBy("row_key").applyInArrow(_join_parts(path), "row_key string, packed binary").toDF(key, held)

    @lean
    def run(batches):
        coder = encoder(path)
        for batch in batches:
            packed = batch.column(batch.num_columns - 1).to_pylist()
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[:-1], *make_long(coder, packed[i : i + 1])], names=schema.names)

    both = long_docs.join(joined, key).select(*docs.columns, held)
    return short.unionByName(both.mapInArrow(run, schema))


def digests(docs: DataFrame, path: str | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    path = path or tokenizer_path()
    docs = docs.select("doc_id", "text")
    schema = extended(docs, n_tokens="long", ids_sha256="string", decoded_sha256="string")
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def make(coder, all_ids):
        decoded = [sha(coder.decode(x).encode("utf-8", "surrogatepass")) for x in all_ids]
        return [pa.array([len(x) for x in all_ids], pa.int64()), pa.array([sha(x.astype("<u4").tobytes()) for x in all_ids]), pa.array(decoded)]

    def make_long(coder, raw):
        return make(coder, [np.frombuffer(x, coder.type) for x in raw])

    return _both(docs, schema, make, make_long, path, part_chars).drop("text")


def op10_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))

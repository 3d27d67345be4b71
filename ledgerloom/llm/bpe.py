"""Operator 4, BPE encoding and decoding as a bounded-lookahead streaming transducer.

A merge can change a token only through a chain of merges that straddle its right edge, each of higher priority than the one it
disturbs. From the merge list alone follows how far right such a chain can reach: the sufficient lookahead (Lookahead below). So a word is
read through a buffer: what ends at least that far before the buffer's end is stable and emitted, the rest is kept. Restarting behind an
emitted token is exact, since no merge crosses its edge. Memory doesn't grow with the word, nor with the text, which is read in
chunks that end at white space. Words that fit the buffer are kept in a bounded cache.

Decoding joins token strings with single spaces, as the vocabulary file has no decoder, and byte strings to text (ByteText) for
vocabularies of bytes; both hold a constant state and take ids in any split.

Defined cases: null and empty texts have no tokens and decode to an empty text; special tokens that occur in a text are their ids;
an empty table gives an empty result; repeated rows and extra columns are as any other.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tokenizer's Unicode tables are older than those of the regex module, by these letters and digits, and newer than
# Python's by these lower-case pairs (first, last, distance).
LATER_LETTERS = """0558 058b-058c 088f 0c5c 0cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959
10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2
18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5
1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"""
LATER_NUMBERS = "11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6"
# Marks and a vowel sign (11930) that the tokenizer's composition tables don't know; there they neither move nor let a letter and a mark past them compose.
LATER_MARKS = """07fd 0898-089f 08ca-08d3 09fe 0c3c 0d3b-0d3c 0eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab-10eac 10efd-10eff 10f46-10f50
10f82-10f85 11070 1133b 1145e 11839-1183a 1193d-1193e 11930 11943 119e0 11a34 11a47 11a99 11d42 11d44-11d45 11d97 11f41-11f42 16ff0-16ff1
1e08f 1e130-1e136 1e2ae 1e2ec-1e2ef 1e4ec-1e4ef"""
LATER_LOWER = [(0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)]

CHUNK = 1 << 16
CACHE = 1 << 18
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where it is printable in Latin-1, else the next code point from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else spare))
        spare += b not in shown
    return out


def code_points(ranges: str) -> str:
    """Hexadecimal ranges as the inside of a character class."""
    return "".join(rf"\U{int(a, 16):08x}-\U{int(b or a, 16):08x}" for x in ranges.split() for a, _, b in [x.partition("-")])


class Merges:
    """Merge list over symbol ids: rank and product of each pair, and the symbols a product is made of."""

    def __init__(self, merges: list[tuple[str, str]], ids: dict[str, int]):
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            if a in ids and b in ids and a + b in ids:
                made = ids[a + b]
                self.pairs.setdefault((ids[a], ids[b]), (rank, made))
                self.parts.setdefault(made, (ids[a], ids[b]))

    def lookahead(self, length: dict[int, int]) -> int:
        """How many symbols past a token's end suffice to know that it stays.

        reach[x]: most symbols right of x's end that a rule with x on its left needs to know whether it applies, over the rules seen
        so far, in order of priority. A rule (u, v) is sure once those that could take a part of it first are: rules of higher
        priority with a part of u or v, ending d symbols before v does, on their left."""
        reach: dict[int, int] = {}
        inner: dict[int, dict[int, int]] = {}

        def ends(x: int) -> dict[int, int]:
            """Each symbol inside x with the least distance from its end to the end of x."""
            if x not in inner:
                out = {x: 0}
                if x in self.parts:
                    a, b = self.parts[x]
                    for y, d in ends(b).items():
                        out[y] = min(d, out.get(y, d))
                    for y, d in ends(a).items():
                        d += length[b]
                        out[y] = min(d, out.get(y, d))
                inner[x] = out
            return inner[x]

        most = 0
        for (u, v), _ in sorted(self.pairs.items(), key=lambda x: x[1][0]):
            need = 0
            for x, d in ends(v).items():
                need = max(need, reach.get(x, 0) - d)
            for x, d in ends(u).items():
                need = max(need, reach.get(x, 0) - d - length[v])
            need += length[v]
            if need > reach.get(u, 0):
                reach[u] = need
                most = max(most, need)
        return most

    def apply(self, symbols: list[int]) -> list[int]:
        """All merges over the symbols, best rank first, then leftmost."""
        n = len(symbols)
        if n < 2:
            return symbols
        pairs = self.pairs
        if n <= 24:
            symbols = list(symbols)
            while len(symbols) > 1:
                best, at = None, -1
                for i in range(len(symbols) - 1):
                    got = pairs.get((symbols[i], symbols[i + 1]))
                    if got is not None and (best is None or got[0] < best[0]):
                        best, at = got, i
                if best is None:
                    break
                symbols[at : at + 2] = [best[1]]
            return symbols
        sym, nxt, prv = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(got[0], i, sym[i], sym[i + 1], got[1]) for i in range(n - 1) if (got := pairs.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = made, -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
                if got := pairs.get((made, sym[nxt[j]])):
                    heapq.heappush(heap, (got[0], i, made, sym[nxt[j]], got[1]))
            if prv[i] >= 0 and (got := pairs.get((sym[prv[i]], made))):
                heapq.heappush(heap, (got[0], prv[i], sym[prv[i]], made, got[1]))
        return [x for x in sym if x >= 0]


class Transducer:
    """Text to ids for a vocabulary file with a word pattern, byte symbols and an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.merges = Merges([tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]], self.ids)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # the pattern's white space is the Unicode property
        pattern = split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.word = regex.compile(pattern, regex.V1)
        later = code_points(f"{LATER_LETTERS} {LATER_NUMBERS}")
        self.later = regex.compile(f"[{later}]")
        self.apart = regex.compile(f"([{code_points(LATER_MARKS)}])")
        # what the older tables don't know is neither a letter nor a number
        known = pattern.replace(r"[^\p{White_Space}\p{L}\p{N}]", rf"(?:[^\p{{White_Space}}\p{{L}}\p{{N}}]|[{later}])").replace(r"[\p{L}]", rf"[\p{{L}}--[{later}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{later}]]")
        self.old_word = regex.compile(known, regex.V1)
        self.lower = {c: c + d for a, b, d in LATER_LOWER for c in range(a, b + 1)}
        self.space = regex.compile(r"\p{White_Space}+")
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        alphabet = byte_alphabet()
        self.byte = [self.ids[c] for c in alphabet]
        self.last = [self.ids[c + self.suffix] for c in alphabet]
        length: dict[int, int] = {i: 1 for i in [*self.byte, *self.last]}

        def measure(x: int) -> int:
            if x not in length:
                a, b = self.merges.parts[x]
                length[x] = measure(a) + measure(b)
            return length[x]

        for x in self.merges.parts:
            measure(x)
        self.length = length
        self.ahead = self.merges.lookahead(length)
        self.buffer = 4 * self.ahead + 256
        self.cache: dict[str, bytes] = {}

    def normal(self, text: str) -> str:
        """Composed form, runs of white space as one space, lower case by code point (no final sigma)."""
        if text.isascii():
            return text.lower()
        # capturing, the split keeps the marks it splits at
        parts = self.apart.split(text) if max(text) >= "\u07fd" else [text]
        text = self.space.sub(" ", "".join([unicodedata.normalize("NFC", x) for x in parts]))
        if max(text, default="") > "\u0557":
            text = text.translate(self.lower)
        return text.replace("Σ", "σ").lower()

    def words(self, text: str) -> list[str]:
        rare = not text.isascii() and max(text) > "\u0557" and self.later.search(text)
        return (self.old_word if rare else self.word).findall(text)

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Ids of one word from its bytes, each emitted once it is stable."""
        held: list[int] = []
        full = self.buffer
        pending = None
        for b in data:
            if pending is not None:
                held.append(self.byte[pending])
            pending = b
            if len(held) >= full:
                done, stable = 0, len(held) - self.ahead
                for token in self.merges.apply(held):
                    if done + self.length[token] > stable:
                        break
                    done += self.length[token]
                    yield token
                held = held[done:]
                full = self.buffer if done else 2 * full
        if pending is not None:
            held.append(self.last[pending])
            yield from self.merges.apply(held)

    def piece(self, word: str) -> bytes:
        """Ids of a word, little-endian."""
        got = self.cache.get(word)
        if got is None:
            got = np.fromiter(self.stream(word.encode()), "<u4").tobytes()
            if len(word) <= 64:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[word] = got
        return got

    def chunks(self, text: str) -> Iterator[str]:
        """The text in parts of about CHUNK code points that start at white space, so that no word or composed letter is cut."""
        at = 0
        while len(text) - at > CHUNK:
            cut = self.space.search(text, at + CHUNK)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of the text in parts, little-endian."""
        at = 0
        for found in self.specials.finditer(text) if self.specials else ():
            yield from self._plain(text[at : found.start()])
            yield self.special[found.group()].to_bytes(4, "little")
            at = found.end()
        yield from self._plain(text[at:])

    def _plain(self, text: str) -> Iterator[bytes]:
        if text:
            cache, piece = self.cache, self.piece
            for chunk in self.chunks(text):
                yield b"".join([cache.get(w) or piece(w) for w in self.words(self.normal(chunk))])


class Joined:
    """Ids to text for a vocabulary without a decoder: token strings with single spaces between. Its state is whether one came before."""

    def __init__(self, strings: dict[int, str]):
        self.strings = [strings.get(i, "") for i in range(max(strings) + 1)]
        self.started = False

    def feed(self, ids: Iterable[int]) -> str:
        strings = self.strings
        out = " ".join([strings[i] for i in ids])
        if not out:
            return ""
        out, self.started = (f" {out}" if self.started else out), True
        return out


class ByteText:
    """Ids to text for a vocabulary of byte strings: an incremental UTF-8 decoder, whose state is at most three bytes."""

    def __init__(self, data: dict[int, bytes]):
        self.data = data
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        return self.state.decode(b"".join([self.data[i] for i in ids]), final)


_loaded: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    return _loaded[path]


SCHEMA = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]


def digests(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """keep columns, n_tokens and digests of ids and decoded text of each row. Ids and text pass through hashes as they are emitted."""
    path = path or vocabulary_path()
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, t) for n, t in SCHEMA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = transducer(path)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for value in batch.column(len(keep)):
                total, a, b, joined = 0, hashlib.sha256(), hashlib.sha256(), Joined.__new__(Joined)
                joined.strings, joined.started = coder_strings(coder), False
                for part in coder.encode(value.as_py() or ""):
                    a.update(part)
                    total += len(part) // 4
                    b.update(joined.feed(np.frombuffer(part, "<u4").tolist()).encode())
                n.append(total)
                ids_hash.append(a.hexdigest())
                text_hash.append(b.hexdigest())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=[f.name for f in schema])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text_")).mapInArrow(run, schema)


def coder_strings(coder: Transducer) -> list[str]:
    if not hasattr(coder, "listed"):
        coder.listed = Joined(coder.strings).strings
    return coder.listed


def encoded(docs: DataFrame, text: str = "text", path: str | None = None, name: str = "token_ids") -> DataFrame:
    """docs with a column of token ids."""
    path = path or vocabulary_path()
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = transducer(path)
        for batch in batches:
            ids = [np.frombuffer(b"".join(coder.encode(v.as_py() or "")), "<u4").astype(np.int64) for v in batch.column(batch.schema.get_field_index(text))]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64)))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)

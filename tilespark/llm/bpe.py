"""Byte-level BPE without a merge loop: encoding by backtracking, decoding by an offset table.

Encoding a piece of text takes the longest token at each place (found for all places by one
Aho-Corasick scan of the reversed piece) and keeps it only if it may follow the token before: two tokens
are compatible if merging never crosses their border, which the pair table decides from the merges. If a
token isn't compatible, its next shorter prefix is tried; if none is left, the token before is taken
back and its end is marked dead. Each place dies once at most, so time is linear, and the result equals
that of the merge rules.

Null and empty texts have no tokens, very long ones take memory in proportion to themselves. Rows are encoded one
by one, repeated ones alike; an empty table gives an empty result; other columns don't matter. A special token's string within a text becomes its id, as the
tokenizer file asks. Vocabulary files stay where they are: the driver reads the file at the given path
and broadcasts its content.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tilespark.llm.common import chunked, frugal, small_batches, text_buffer, worker_tables
from tilespark.llm.units import WHITE, UnitCache, no_cycle_search

#: Fixed value: the split pattern of the byte-level pre-tokenizer.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
UNITS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


#: Bounds of the caches of a worker: pieces and units of text, and slots for compatible pairs.
MOST_PIECES, MOST_UNITS, FITS_BITS = 50_000, 120_000, 19
FITS_MASK = (1 << FITS_BITS) - 1


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: printable bytes
    stand for themselves, the others take the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Tables of one tokenizer file (its JSON text). Inside, tokens are numbered by rank: bytes, then
    merges in order."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, letters = spec["model"], byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        raw = lambda s: bytes(letters[c] for c in s)
        self.token: list[bytes] = [bytes([b]) for b in range(256)]
        rank: dict[bytes, int] = {t: i for i, t in enumerate(self.token)}
        self.split: list[tuple[int, int]] = [(i, i) for i in range(256)]
        self.pair: dict[tuple[int, int], int] = {}
        outer = {raw(s): i for s, i in vocab.items()}
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            a, b = raw(a), raw(b)
            if a in rank and b in rank and a + b not in rank:
                rank[a + b] = len(self.token)
                self.token.append(a + b)
                self.split.append((rank[a], rank[b]))
                self.pair[rank[a], rank[b]] = rank[a + b]
        self.rank, self.outer = rank, [outer[t] for t in self.token]
        self.shorter = [next((rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in rank), -1) for t in self.token]
        self.size = [len(t) for t in self.token]
        # what is known of pairs: a slot for each remainder of the key, the latest pair stays
        self.fits_key, self.fits_value = array("Q", bytes(8 << FITS_BITS)), bytearray(1 << FITS_BITS)
        self.inside: dict[int, bool] = {}
        scan = ahocorasick.Automaton()
        for t, i in rank.items():
            scan.add_word(t[::-1].decode("latin-1"), i)
        scan.make_automaton()
        self.scan = scan
        # decoding: bytes of every id, one after another, and where each begins
        by_id: dict[int, bytes] = {o: t for o, t in zip(self.outer, self.token, strict=True)}
        by_id |= {i: s.encode() for s, i in self.special.items()}
        top = max(by_id) + 1
        self.len_of = np.array([len(by_id.get(i, b"")) for i in range(top)], np.int64)
        self.at_of = np.cumsum(self.len_of) - self.len_of
        self.all_bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(top)), np.uint8)
        self.parts = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cache = UnitCache(self.encode_units, MOST_UNITS)
        self.pieces: dict[str, list[int]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b can stand right after token a: no merge of lower rank joins what lies at their
        border. Walks down the two tokens' merge trees along the border, later merge first."""
        key = (a << 32 | b) + 1
        slot = (a * 0x9E3779B1 ^ b * 0x85EBCA6B) & FITS_MASK
        if self.fits_key[slot] == key:
            return self.fits_value[slot] == 1
        left, right, bound, split, out = a, b, 1 << 62, self.split, True
        while True:
            joined = self.pair.get((left, right))
            if joined is not None and joined < bound:
                out = False
                break
            # undo the later of the two merges; a merge at the border before that one would have won
            if left > right and left >= 256 or right < 256:
                if left < 256:
                    break
                bound, left = left, split[left][1]
            else:
                bound, right = right + 1, split[right][0]
        self.fits_key[slot], self.fits_value[slot] = key, out
        return out

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece. One scan of all pieces; a character beyond the bytes parts them."""
        raws = [p.encode() for p in pieces]
        text = "\u0100".join(r[::-1].decode("latin-1") for r in raws)
        longest: dict[int, int] = {}
        for end, t in self.scan.iter(text):
            if end not in longest or self.size[t] > self.size[longest[end]]:
                longest[end] = t
        out, base = [], 0
        for r in raws:
            n = len(r)
            whole = self.rank.get(r)
            out.append([self.outer[t] for t in ([whole] if whole is not None and longest[base + n - 1] == whole and self.alone(whole) else self.backtrack(n, longest, base + n - 1))])
            base += n + 1
        return out

    def alone(self, t: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        a, b = self.split[t]
        return t < 256 or self.compatible_inside(a, b, t)

    def compatible_inside(self, a: int, b: int, t: int) -> bool:
        known = self.inside.get(t)
        if known is None:
            known = self.inside[t] = self.backtrack(self.size[t], *self.scan_one(self.token[t])) == [t]
        return known

    def scan_one(self, r: bytes) -> tuple[dict[int, int], int]:
        longest: dict[int, int] = {}
        for end, t in self.scan.iter(r[::-1].decode("latin-1")):
            if end not in longest or self.size[t] > self.size[longest[end]]:
                longest[end] = t
        return longest, len(r) - 1

    def backtrack(self, n: int, longest: dict[int, int], first: int) -> list[int]:
        """longest[first - p]: the longest token at place p of the piece."""
        size, shorter = self.size, self.shorter
        alive = bytearray(b"\x01") * (n + 1)
        got: list[int] = []
        at, t = 0, longest[first] if n else -1
        while at < n:
            end = at + size[t]
            if alive[end] and (not got or self.compatible(got[-1], t)):
                got.append(t)
                at = end
                t = longest[first - at] if at < n else -1
                continue
            t = shorter[t]
            while t < 0:
                alive[at] = 0
                last = got.pop()
                at -= size[last]
                t = shorter[last]
        return got

    def encode_units(self, units: list[str]) -> list[list[int]]:
        split = [PIECES.findall(u) for u in units]
        new = list({p for ps in split for p in ps if p not in self.pieces})
        if len(self.pieces) > MOST_PIECES:
            self.pieces.clear()
            new = list({p for ps in split for p in ps})
        self.pieces.update(zip(new, self.encode_pieces(new), strict=True))
        known = self.pieces
        return [known[ps[0]] if len(ps) == 1 else [i for p in ps for i in known[p]] for ps in split]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin."""
        find = UNITS.findall
        if not self.parts or not any(s in t for t in texts for s in self.special):
            per = [find(t) for t in texts]
            return self.cache.ids([u for p in per for u in p], np.fromiter(map(len, per), np.int64, len(per)))
        out, lens = [], []
        for t in texts:
            own = []
            for part in self.parts.split(t):
                if part in self.special:
                    own.append(np.array([self.special[part]], np.uint32))
                elif part:
                    u = find(part)
                    own.append(self.cache.ids(u, np.array([len(u)]))[0])
            out += own
            lens.append(sum(map(len, own)))
        return np.concatenate([np.zeros(0, np.uint32), *out]), np.r_[0, np.cumsum(lens)].astype(np.int64)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids."""
        ids = ids.astype(np.int64)
        n = self.len_of[ids]
        ends = np.cumsum(n)
        return self.all_bytes[np.repeat(self.at_of[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


_loaded: dict[str, Bpe] = {}


def loaded(content: str) -> Bpe:
    """The tables of a tokenizer file, built once in each Python process."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Bpe(content)
    worker_tables["bpe"] = _loaded.clear
    return _loaded[key]


def lossy(raw: bytes) -> bytes:
    return raw.decode("utf-8", "replace").encode()


def roundtrip(docs: DataFrame, tokenizer: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, array<int>, if asked) of every whole text,
    encoded with the tokenizer file at that path and decoded again."""
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def code(batches):
        bpe = loaded(shared.value)
        for b in batches:
            sizes, ids_sha, text_sha, kept = [], [], [], []
            for _, _, data, offs in chunked(*text_buffer(b.column("text")), 1 << 18):
                raw = data.tobytes()
                with no_cycle_search():
                    ids, at = bpe.encode_batch([raw[offs[i] : offs[i + 1]].decode("utf-8", "replace") for i in range(len(offs) - 1)])
                back = bpe.decode(ids)
                ends = np.r_[0, np.cumsum(bpe.len_of[ids.astype(np.int64)])][at]
                whole, text = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B"), memoryview(np.ascontiguousarray(back)).cast("B")
                for i in range(len(offs) - 1):
                    sizes.append(int(at[i + 1] - at[i]))
                    ids_sha.append(hashlib.sha256(whole[4 * at[i] : 4 * at[i + 1]]).hexdigest())
                    own = bytes(text[ends[i] : ends[i + 1]])
                    text_sha.append(hashlib.sha256(own if own == raw[offs[i] : offs[i + 1]] else lossy(own)).hexdigest())
                    if keep_ids:
                        kept.append(ids[at[i] : at[i + 1]].astype(np.int32))
            arrays = [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays, names = [*arrays, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(frugal(code, "bpe"), schema)

"""BPE encoding and decoding in batched numpy merge rounds.

All new words of a batch lie in one flat array of symbol ids. A round looks up the rank of every adjacent pair by
binary search over the sorted pair keys, finds the lowest rank of each word and merges its occurrences from the
left, in all words at once; it ends when no word has a known pair left. Words met before come from a bounded memory.
A word of more than ``LONG`` bytes goes by itself: its places wait in one list per rank, and a round takes the lowest
list and looks up only the pairs that the merges made, so the work follows the merges, not rounds times length.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an empty text; repeated rows
give equal rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.iinfo(np.int64).max
LONG = 256


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], extra = chr(extra), extra + 1
    return [out[b] for b in range(256)]


class WordBpe:
    """A word-end BPE read from a tokenizers file: lower case, blanks dropped, ``</w>`` closes a word."""

    def __init__(self, path: str, remembered: int = 300_000) -> None:
        import regex

        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        self.names = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.special.items()})
        alphabet = byte_alphabet()
        self.alphabet = {c: b for b, c in enumerate(alphabet)}
        self.inner = np.array([vocab.get(c, -1) for c in alphabet], np.int64)
        self.last = np.array([vocab.get(c + self.end, -1) for c in alphabet], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.remembered, self.known = remembered, {}

    def normal(self, text: str) -> str:
        """NFC, white space to blanks, each character in lower case on its own."""
        text = unicodedata.normalize("NFC", text)
        return text.lower() if text.isascii() or "Σ" not in text else "".join(c.lower() for c in text)

    def cut(self, text: str) -> list[str]:
        """Words of a text without special tokens.

        Characters newer than Python's tables have no known letter class or case here; such texts are cut by the library.
        """
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            normal = self.library.normalizer.normalize_str(text)
            return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return self.words.findall(self.normal(text))

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word's ids begin (with the end of all)."""
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ids, ends = self.inner[data], np.cumsum(size) - 1
        ids[ends] = self.last[data[ends]]
        owner = np.repeat(np.arange(len(words)), size)
        done_ids, done_owner = [], []
        while len(ids):
            rank = np.full(len(ids), NONE)
            same = owner[1:] == owner[:-1]
            if same.any():
                at = np.flatnonzero(same)
                rank[at] = self.pair_ranks(ids[at], ids[at + 1])
            starts = np.flatnonzero(np.r_[True, ~same])
            best = np.minimum.reduceat(rank, starts)
            count = np.diff(np.r_[starts, len(ids)])
            going = best < NONE
            keep = np.repeat(going, count)
            if not keep.all():  # words without a known pair leave
                done_ids.append(ids[~keep])
                done_owner.append(owner[~keep])
                ids, owner, rank = ids[keep], owner[keep], rank[keep]
                best, count = best[going], count[going]
                if not len(ids):
                    break
            hit = rank == np.repeat(best, count)
            # a run of overlapping hits (a a a) merges at every second place from its start
            place = np.arange(len(hit))
            begin = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, 0))
            hit &= (place - begin) % 2 == 0
            ids = np.where(hit, self.merged[np.minimum(rank, len(self.merged) - 1)], ids)
            stay = ~np.r_[False, hit[:-1]]
            ids, owner = ids[stay], owner[stay]
        flat, who = np.concatenate(done_ids or [ids]), np.concatenate(done_owner or [owner])
        order = np.argsort(who, kind="stable")
        flat, bounds = flat[order], np.r_[0, np.cumsum(np.bincount(who, minlength=len(words)))]
        return flat, bounds

    def merge_long(self, word: str) -> np.ndarray:
        """Ids of one long word: the same rounds, over places linked to the next and the one before."""
        data = np.frombuffer(word.encode(), np.uint8)
        n, ids = len(data), self.inner[data]
        ids[-1] = self.last[data[-1]]
        after, before, waiting, ranks = np.arange(1, n + 1), np.arange(-1, n - 1), {}, []

        def wait(at: np.ndarray) -> None:
            at = at[after[at] < n]
            rank = self.pair_ranks(ids[at], ids[after[at]])
            order = np.argsort(rank, kind="stable")
            order = order[:np.searchsorted(rank[order], NONE)]
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for part, r in zip(np.split(at, cuts), rank[np.r_[0, cuts]].tolist() if len(rank) else [], strict=False):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(part)

        gone = np.zeros(n, bool)
        wait(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[~gone[at] & (after[at] < n)]
            at = at[self.pair_ranks(ids[at], ids[after[at]]) == r]
            if not len(at):
                continue
            place = np.arange(len(at))  # a run of overlapping pairs merges at every second place from its start
            begin = np.maximum.accumulate(np.where(np.r_[True, at[1:] != after[at[:-1]]], place, 0))
            at = at[(place - begin) % 2 == 0]
            right = after[at]
            gone[right], ids[at], after[at] = True, self.merged[r], after[right]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            left = before[at]
            wait(np.unique(np.concatenate([left[left >= 0], at])))
        return ids[~gone]

    def learn(self, words: list[str]) -> None:
        """Remember for each word: count of ids, ids as text, decoded text."""
        for w in (w for w in words if len(w) > LONG):
            ids = self.merge_long(w).tolist()
            self.known[w] = (len(ids), " ".join(map(str, ids)), " ".join([self.names[i] for i in ids]))
        words = [w for w in words if len(w) <= LONG]
        flat, bounds = self.merge(words)
        names = [self.names[i] for i in flat.tolist()]
        flat, bounds = list(map(str, flat.tolist())), bounds.tolist()
        for w, a, b in zip(words, bounds, bounds[1:], strict=False):
            self.known[w] = (b - a, " ".join(flat[a:b]), " ".join(names[a:b]))

    def split(self, text: str) -> list[tuple[str, bool]]:
        """Parts of a raw text; True marks a special token."""
        if self.specials is None or not any(s in text for s in self.special):
            return [(text, False)]
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [(text[at:m.start()], False), (m.group(), True)]
            at = m.end()
        return [*out, (text[at:], False)]

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by blanks, decoded text) of each text."""
        if len(self.known) > self.remembered:
            self.known = {}
        cut = []
        for text in texts:
            words = []
            for part, special in self.split(text):
                words += [(part,)] if special else self.cut(part)
            cut.append(words)
        known = self.known
        new = list({w for words in cut for w in words if w not in known and isinstance(w, str)})
        if new:
            self.learn(new)
        for words in cut:
            for w in words:
                if isinstance(w, tuple) and w not in known:
                    known[w] = (1, str(self.special[w[0]]), w[0])
        out = []
        for words in cut:
            got = [known[w] for w in words]
            out.append((sum(g[0] for g in got), " ".join([g[1] for g in got]), self.decode_names([g[2] for g in got])))
        for w in new:
            if len(w) > LONG:  # the memory counts words, not bytes
                del known[w]
        return out

    def decode_names(self, names: list[str]) -> str:
        return " ".join(names)

    def decode(self, ids: list[int]) -> str:
        """Decoding of a file without a decoder: the tokens as they are, joined by blanks."""
        return self.decode_names([self.names[i] for i in ids if i in self.names])


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", batch: int = 512) -> DataFrame:
    """(id, n_tokens, ids, decoded): ids as decimal numbers joined by one blank, decoded as text."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, got in encoded(frames, tokenizer, id_col, batch):
            yield pd.DataFrame({id_col: keys, "n_tokens": [g[0] for g in got], "ids": [g[1] for g in got], "decoded": [g[2] for g in got]})

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInPandas(run, f"{id_col} long, n_tokens long, ids string, decoded string")


def encoded(frames: Iterator[pd.DataFrame], tokenizer: str, id_col: str, batch: int):
    bpe = WordBpe(tokenizer)
    for frame in frames:
        for at in range(0, len(frame), batch):
            part = frame.iloc[at:at + batch]
            yield part[id_col].astype("Int64").to_numpy(dtype=object, na_value=None), bpe.encode([t or "" for t in part["text"]])


def digest_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", batch: int = 512) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), the digests taken where the ids are made."""
    def digest(s: str) -> str:
        return hashlib.sha256(s.encode()).hexdigest()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, got in encoded(frames, tokenizer, id_col, batch):
            yield pd.DataFrame({id_col: keys, "n_tokens": [g[0] for g in got], "ids_sha256": [digest(g[1]) for g in got],
                                "decoded_sha256": [digest(g[2]) for g in got]})

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInPandas(
        run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")

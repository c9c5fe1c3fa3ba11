"""Language identification with a byte convolutional network over windows of fixed length.

The network is trained in numpy on a bounded sample of labelled texts: ``sample`` documents, shared out over all labelled
languages, and of each at most ``per_text`` windows, which are cut in the tasks; only windows reach the driver. Its few
thousand weights travel with the task. Every window of every text is scored, in batches; a text's probabilities are
the mean over its windows.

One more class stands for no language. Its windows are made from the labelled ones (bytes in random order) and from
alphabets of codes (hexadecimal, base 64, digits, all printable). ``identify`` picks among the languages alone;
``accepted`` keeps what the network finds likelier to be in a language than not, with a bound that leaves the share
``stay`` of the labelled sample.

Defined results: a null text, an empty one and one without letters get ``und`` and score 0; so does every text where
nothing is labelled; repeated rows get equal answers; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytecnn import ByteConvNet, cut_windows, mean_by, softmax
from .common import bounded_sample_by

UNKNOWN = "und"
WINDOW, HOP = 256, 252  # the hop leaves out the last places only where no filter would fit
#: Alphabets of texts in no language.
CODES = (b"0123456789abcdef", b"0123456789ABCDEF", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", bytes(range(32, 127)),
         b"0123456789 .,:;-_/|", b"abcdefghijklmnopqrstuvwxyz")


@dataclass
class LanguageModel:
    net: ByteConvNet | None
    languages: list[str]
    bound: float = 0.5

    def probabilities(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(has letters, probability of each language and, last, of none) of each text."""
        import regex

        letter = regex.compile(r"\p{L}")
        known = np.array([bool(t and letter.search(t)) and self.net is not None for t in texts], bool)
        if not known.any():
            return known, np.zeros((len(texts), len(self.languages) + 1))
        windows, owner = cut_windows([t.encode() if k else b"" for t, k in zip(texts, known, strict=True)], WINDOW, HOP)
        return known, mean_by(softmax(self.net.logits(windows)), owner, len(texts))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        known, p = self.probabilities(texts)
        if not known.any():
            return [(UNKNOWN, 0.0)] * len(texts)
        share = p[:, :-1] / np.maximum(p[:, :-1].sum(1, keepdims=True), 1e-30)
        best = share.argmax(1)
        return [(self.languages[b], float(min(1.0, share[i, b]))) if known[i] else (UNKNOWN, 0.0) for i, b in enumerate(best)]

    def stays(self, texts: list[str | None]) -> np.ndarray:
        known, p = self.probabilities(texts)
        return known & (p[:, -1] <= self.bound)


def windows_of(text: Column, per_text: int) -> Column:
    """At most ``per_text`` windows of a text, drawn by a generator that the text seeds."""
    import zlib

    @F.pandas_udf("array<binary>")
    def draw(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            raw = t.encode()
            n = 1 + max(0, -(-(len(raw) - WINDOW) // HOP)) if raw else 0
            pick = np.sort(np.random.default_rng(zlib.crc32(raw)).permutation(n)[:per_text])
            out.append([raw[i * HOP:i * HOP + WINDOW].ljust(WINDOW, b"\0") for i in pick])
        return pd.Series(out, dtype=object)

    return draw(text)


def in_no_language(windows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Windows of codes, words of codes, and of labelled windows with their bytes in random order."""
    mixed = windows[rng.integers(0, len(windows), max(64, len(windows) // 6))]
    out = [rng.permuted(mixed, axis=1)]
    for code in CODES:
        drawn = np.frombuffer(code, np.uint8)[rng.integers(0, len(code), (max(32, len(windows) // 30), WINDOW))]
        blanks = rng.random(drawn.shape) < rng.choice([0.0, 0.03, 0.15], (len(drawn), 1))
        out.append(np.where(blanks, np.uint8(32), drawn))
    made = np.concatenate(out)
    short = np.where(rng.random(len(made)) < 0.3, rng.integers(8, WINDOW, len(made)), WINDOW)
    return np.where(np.arange(WINDOW) < short[:, None], made, 0).astype(np.uint8)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 4000,
          per_text: int = 6, steps: int = 1500, stay: float = 0.999) -> LanguageModel:
    """``labelled``: rows to learn from; those without text or language are left out. ``stay``: the share of the sample that ``accepted`` would keep."""
    rows = labelled.select(id_col, F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("length(text) > 0 and lang is not null")
    drawn = bounded_sample_by(rows, id_col, "lang", sample).select(id_col, "lang", windows_of(F.col("text"), per_text).alias("cuts")).collect()
    if not drawn:
        return LanguageModel(None, [])
    drawn.sort(key=lambda r: (r["lang"], r[id_col] is not None, r[id_col] or 0, r["cuts"]))
    languages = sorted({r["lang"] for r in drawn})
    windows = np.frombuffer(b"".join(bytes(c) for r in drawn for c in r["cuts"]), np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(drawn)), [len(r["cuts"]) for r in drawn])
    y = np.array([languages.index(r["lang"]) for r in drawn])[owner]
    none = in_no_language(windows, np.random.default_rng(3))
    seen, labels = np.concatenate([windows, none]), np.r_[y, np.full(len(none), len(languages))]
    share = np.bincount(labels, minlength=len(languages) + 1) / len(labels)
    net = ByteConvNet(classes=len(languages) + 1, widths=(2, 3, 4, 5), filters=10)
    net.fit(seen, labels, (1 / np.sqrt(np.maximum(share, 1e-9)))[labels], steps=steps)
    p = mean_by(softmax(net.logits(windows)), owner, len(drawn))[:, -1]
    return LanguageModel(net, languages, max(0.5, float(np.quantile(p, stay, method="higher"))))


def verdict(model: LanguageModel, text: Column, batch: int = 256) -> Column:
    """struct(lang_pred, score) of a whole text."""
    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        got = [g for i in range(0, len(texts), batch) for g in model.predict(list(texts[i:i + batch]))]
        return pd.DataFrame({"lang_pred": pd.Series([g[0] for g in got], dtype=object), "score": pd.Series([g[1] for g in got], dtype=float)})

    return judge(text)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text."""
    return docs.select(F.col(id_col).cast("long").alias(id_col), verdict(model, F.col(text_col)).alias("v")).select(id_col, "v.lang_pred", "v.score")


def accepted(docs: DataFrame, model: LanguageModel, text_col: str = "text", batch: int = 256) -> DataFrame:
    """The documents with letters that the network finds in a language, all their columns as they are."""
    @F.pandas_udf("boolean")
    def stays(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([np.zeros(0, bool), *(model.stays(list(texts[i:i + batch])) for i in range(0, len(texts), batch))]))

    return docs.where(stays(F.col(text_col)))

"""Encoding and decoding with a word-level BPE vocabulary (operator 5).

Per-prefix dynamic programming. In byte-pair encoding the last token of the
encoding of each prefix of a word is unique: it is the token ending there whose
start is the end of another prefix and which is compatible with that prefix's
last token. So one pass over a word stores one token for every prefix:

* an automaton over all vocabulary strings lists the tokens that end at each
  position (the suffixes of the prefix that are tokens), longest first;
* a pair of neighbours is compatible if the merge order would leave exactly
  these two tokens, which is found by undoing merges on both sides of their
  border;
* following the stored tokens back from the end of the word gives its ids.

Work is linear in the length of a word times the number of tokens that end at
one position. Words are remembered in each worker, up to a fixed number.

Defined results: null texts are empty: no ids, and an empty decoded text; every
input row gives one row; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .base import map_batches, tune
from .bytebpe import UNKNOWN, WHITE, byte_letters

#: The file's words (fixed values of the format).
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+")
#: What str.split() takes for white space but the file doesn't.
SEPARATORS = regex.compile(r"[\x1c-\x1f]")
#: Runs that a worker remembers in each of two generations; and their longest size.
REMEMBER, LONGEST_RUN = 250_000, 64


class Remembered(dict):
    """A bounded memo in two generations: what was used lately stays."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, run: str) -> tuple[bytes, str]:
        made = self.old.get(run)
        if made is None:
            made = self.make(run)
        if len(run) <= LONGEST_RUN:
            if len(self) >= REMEMBER:
                self.old = dict(self)
                self.clear()
            self[run] = made
        return made


class WordBpe:
    """Encoder of one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normal, self.pre, self.unknown = library.normalizer, library.pre_tokenizer, re.compile(f"[{UNKNOWN}]")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ending = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.names = {n: t for t, n in vocab.items()} | {n: t for t, n in self.special.items()}
        self.letters = {b: ord(c) for c, b in byte_letters().items()}
        # rank 0: a single letter; else the place of its merge, so a lower rank merges earlier
        self.rank, self.halves, self.joined = {}, {}, {}
        for n, (a, b) in enumerate(tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]):
            made = vocab[a + b]
            self.rank[made], self.halves[made] = n + 1, (vocab[a], vocab[b])
            self.joined[vocab[a], vocab[b]] = n + 1
        self.inner = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.final: dict[str, int] = {}
        self.sizes = [0] * (max(self.names) + 1)
        for token, n in vocab.items():
            if token in self.special:
                continue
            if token.endswith(self.ending) and len(token) > len(self.ending):
                self.final[token[: -len(self.ending)]] = n
                self.sizes[n] = len(token) - len(self.ending)
            else:
                self.inner.add_word(token, n)
                self.sizes[n] = len(token)
        self.inner.make_automaton()
        self.longest = max(map(len, self.final))
        self.fits: dict[int, bool] = {}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.runs = Remembered(self.encode_run)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging would leave these two tokens side by side.

        Undoes the later of the two last merges, again and again, and looks at
        each step whether the tokens that meet at the border would have been
        merged before the merge that was undone last on either side.
        """
        rank, halves, joined = self.rank, self.halves, self.joined
        bound_left = bound_right = 1 << 60  # ranks of the merges that used up the border tokens
        while True:
            merge = joined.get((left, right))
            # on equal time the left-most pair goes first: a merge over the border beats one to its right
            if merge is not None and merge < bound_left and merge <= bound_right:
                return False
            a, b = rank.get(left, 0), rank.get(right, 0)
            if not a and not b:
                return True
            if a > b:
                bound_left = a
                left = halves[left][1]
            else:
                bound_right = b
                right = halves[right][0]

    def fit(self, left: int, right: int) -> bool:
        """:meth:`compatible`, remembered."""
        if len(self.fits) > 1_500_000:
            self.fits.clear()
        good = self.fits[left << 20 | right] = self.compatible(left, right)
        return good

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, written in stand-in letters."""
        end, fits, sizes = len(word) - 1, self.fits, self.sizes
        last = [0] * end  # by prefix: the last token of its encoding
        done = -1
        for at, token in self.inner.iter(word, 0, end) if end else ():
            if at == done:
                continue
            before = at - sizes[token]
            if before >= 0:
                good = fits.get(last[before] << 20 | token)
                if good is None:
                    good = self.fit(last[before], token)
                if not good:
                    continue
            last[at] = token
            done = at
        final, before, token = self.final, -1, None
        for begin in range(max(0, end + 1 - self.longest), end + 1):
            token = final.get(word[begin:])
            if token is not None:
                before = begin - 1
                if before < 0:
                    break
                good = fits.get(last[before] << 20 | token)
                if good if good is not None else self.fit(last[before], token):
                    break
        ids = [token]
        while before >= 0:
            token = last[before]
            ids.append(token)
            before -= sizes[token]
        ids.reverse()
        return ids

    def encode_run(self, run: str) -> tuple[bytes, str]:
        """Ids as bytes, and names joined by blanks, of a text without white space."""
        plain = run.isascii()
        if plain:
            low = run.lower()
        elif self.unknown.search(run):
            ids = [n for word, _ in self.pre.pre_tokenize_str(self.normal.normalize_str(run)) for n in self.encode_word(word)]
            return array("I", ids).tobytes(), " ".join([self.names[n] for n in ids])
        else:  # NFC, then lower case letter by letter (no final sigma)
            low = unicodedata.normalize("NFC", run).replace("\u03a3", "\u03c3").lower()
        words = [low] if plain and low.isalpha() else WORDS.findall(low)
        if words == [run]:
            ids = self.encode_word(run if plain and run.isalpha() else run.encode().decode("latin-1").translate(self.letters))
            return array("I", ids).tobytes(), " ".join([self.names[n] for n in ids])
        found = [self.runs[w] for w in words]
        return b"".join([x for x, _ in found]), " ".join([x for _, x in found])

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian uint32 bytes, and the decoded text."""
        if self.cut and any(s in text for s in self.special):
            parts, at = [], 0
            for m in self.cut.finditer(text):
                parts += [self.encode_plain(text[at : m.start()]), (array("I", [self.special[m[0]]]).tobytes(), m[0])]
                at = m.end()
            parts.append(self.encode_plain(text[at:]))
            return b"".join([x for x, _ in parts]), " ".join([y for x, y in parts if x])
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> tuple[bytes, str]:
        """As :meth:`encode`, of a text without special strings: its runs between white space, one by one."""
        if SEPARATORS.search(text):
            runs = [x for x in regex.split(f"[{WHITE}]+", text) if x]
        else:
            runs = text.split()
        found = [x for x in map(self.runs.__getitem__, runs) if x[0]]
        return b"".join([x for x, _ in found]), " ".join([x for _, x in found])

    def decode(self, ids: list[int]) -> str:
        """Token names joined by blanks: the file has no decoder."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """The encoder of a file, made once in each worker."""
    return WordBpe(path)


def encode_decode(docs: DataFrame, tokenizer: str, outputs: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with ``outputs`` also ids (little-endian uint32) and decoded."""
    tune(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder, rows = load(tokenizer), []
        for text in batch.column(1).to_pylist():
            ids, out = encoder.encode(text or "")
            digests = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(out.encode()).hexdigest())
            rows.append((*digests, ids, out) if outputs else digests)
        names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 5 if outputs else 3]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, type=k) for x, k in zip(columns, kinds))], names=["doc_id", *names])

    more = ", ids binary, decoded string" if outputs else ""
    return map_batches(docs.select("doc_id", "text"), work, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")

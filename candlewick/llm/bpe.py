"""BPE encoding and decoding with forced boundaries: cut where no token can reach across, encode the fragments."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from candlewick.llm.common import Memo, documents, map_texts, texts


def default_path(name: str) -> str:
    """Where the installed public tokenizers keep a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def inner_pairs(tokens: Iterable[Sequence]) -> set:
    """All pairs of neighbouring symbols inside any token."""
    return {pair for t in tokens for pair in zip(t, t[1:])}


def fragments(symbols: Sequence, pairs: set) -> list[Sequence]:
    """Cut between neighbours that are side by side in no token: no merge can ever reach across."""
    cuts = [i for i, pair in enumerate(zip(symbols, symbols[1:]), 1) if pair not in pairs]
    return [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)])] if cuts else [symbols]


def merge(symbols: list[str], rank: Callable[[str, str], float | None]) -> list[str]:
    """Merge neighbours, lowest rank first and leftmost among equals, until no pair has a rank."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, symbols[i] + symbols[i + 1]) for i in range(n - 1) if (r := rank(symbols[i], symbols[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = after[i]
        if symbols[i] is None or j >= n or symbols[i] + symbols[j] != joined:
            continue  # one side has merged meanwhile
        symbols[i], symbols[j] = joined, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank(joined, symbols[k])) is not None:
                heapq.heappush(heap, (r, i, joined + symbols[k]))
        if (h := before[i]) >= 0 and (r := rank(symbols[h], joined)) is not None:
            heapq.heappush(heap, (r, h, symbols[h] + joined))
    return [s for s in symbols if s is not None]


class WordBpe:
    """Encoder and decoder for a ``tokenizers`` file of lower-case word BPE: NFC, blanks joined, ``</w>`` at word ends.

    ``piece`` gives an encoded stretch between blanks: its ids as little-endian 32-bit numbers and the
    decoded text. Both are kept in memos, for stretches and for fragments.
    """

    END = "</w>"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.pairs = inner_pairs(t.removesuffix(self.END) for t in self.vocabulary)
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        # beyond Latin letters, Unicode versions differ: there the library's own rules say what letters are; the
        # separator controls x1c to x1f are blanks for Python alone
        self.odd = re.compile("[^\x00-\x1b\x20-\u024f]")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = regex.compile("|".join(map(regex.escape, self.special)))
        alphabet = sorted(ByteLevel.alphabet())
        # the byte alphabet: printable bytes stand for themselves, the others follow from 256 on in order
        others = [b for b in range(256) if chr(b) not in alphabet]
        self.letters = {b: chr(256 + i) for i, b in enumerate(others)}
        self.names = {i: t for t, i in self.vocabulary.items()} | {i: t for t, i in self.special.items()}
        self.fragment = Memo(self._fragment)
        self.piece = Memo(self._piece)

    def _fragment(self, fragment: str) -> tuple[bytes, str]:
        """A fragment's tokens; one that ends a word has a line end after it, which no word holds."""
        last = fragment[-1] == "\n"
        symbols = list(fragment[:-1] if last else fragment)
        if last:
            symbols[-1] += self.END
        ranks, vocabulary = self.ranks, self.vocabulary
        return self._packed([vocabulary[s] for s in merge(symbols, lambda a, b: ranks.get((a, b))) if s in vocabulary])

    def _piece(self, stretch: str) -> tuple[bytes, str]:
        if self.odd.search(stretch):
            words = [w for w, _ in self.splitter.pre_tokenize_str(stretch)]
        else:
            words = [w.encode().decode("latin-1").translate(self.letters) for w in self.words.findall(stretch)]
        found = []
        for word in words:
            parts = fragments(word, self.pairs)
            found += [self.fragment[part] for part in parts[:-1]]
            found.append(self.fragment[parts[-1] + "\n"])
        if len(found) == 1:
            return found[0]
        return b"".join(i for i, _ in found), " ".join(n for _, n in found if n)

    def _packed(self, ids: list[int]) -> tuple[bytes, str]:
        return b"".join(i.to_bytes(4, "little") for i in ids), " ".join(self.names[i] for i in ids)

    def _stretches(self, text: str) -> list[str]:
        """A normalized text cut at blanks, which split as white space does where no separator control is in it."""
        if self.odd.search(text):
            return self.normalizer.normalize_str(text).split(" ")
        return unicodedata.normalize("NFC", text).lower().split()

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids (packed) of a whole text, and these decoded: token names joined by blanks."""
        piece = self.piece
        if "<|" not in text:
            found = [piece[s] for s in self._stretches(text)]
        else:
            found, at = [], 0
            for m in self.marks.finditer(text):
                found += [piece[s] for s in self._stretches(text[at : m.start()])]
                found.append(self._packed([self.special[m.group()]]))
                at = m.end()
            found += [piece[s] for s in self._stretches(text[at:])]
        return b"".join([ids for ids, _ in found]), " ".join([names for _, names in found if names])


@lru_cache(maxsize=2)
def coder(path: str) -> WordBpe:
    """The encoder of a file, kept with its memos for all tasks of a Python worker."""
    return WordBpe(path)


def bpe_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of documents.

    Null text counts as empty and has no tokens; texts of any length are encoded whole; repeated rows and null
    doc_id stay; an empty table gives no rows; other columns are ignored.
    """

    def make() -> Callable[[list], dict]:
        encode = coder(path or default_path("word_bpe_49k.json")).encode

        def work(batch: list) -> dict:
            out: dict = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in batch:
                ids, decoded = encode(text or "")
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            return out

        return work

    return map_texts(texts(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with word_bpe_49k.json."""
    return bpe_round_trip(documents(spark, sf_dir))

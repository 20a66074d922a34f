"""Token counts by heap-and-linked-list merging: initial symbols less merges, without any identifiers."""

from __future__ import annotations

import heapq
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from candlewick.llm.bpe import default_path, fragments, inner_pairs
from candlewick.llm.common import Memo, documents, map_texts, texts

BLANK = "▁"
LIMIT = 4096


class PieceCounter:
    """Counts the tokens that a sentencepiece BPE model with byte fallback gives, as its defaults do."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as format_

        model = format_.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal = format_.ModelProto.SentencePiece.Type.NORMAL
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == normal}
        self.pairs = inner_pairs(self.rank)
        if any(BLANK in p.lstrip(BLANK) for p in self.rank) or model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models without normalization whose pieces have blanks at their start alone")
        self.prefix = BLANK if model.normalizer_spec.add_dummy_prefix else ""
        self.fragment = Memo(self._fragment)
        self.stretch = Memo(lambda s: sum(self.fragment[f] for f in fragments(s, self.pairs)), 400_000)

    def _fragment(self, text: str) -> int:
        """Initial symbols (bytes of characters that no piece has) less merges."""
        rank = self.rank
        n = len(text)
        count = sum(1 if c in rank else len(c.encode()) for c in text)
        if n == 1 or text in rank and n == 2:
            return count - (n == 2)
        ends = list(range(1, n + 1))  # of the symbol that starts at i: also where the next one starts
        before = list(range(-1, n - 1))
        live = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not live[i] or (j := ends[i]) >= n or ends[j] != end:
                continue  # one side has merged meanwhile
            ends[i], live[j] = end, False
            count -= 1
            if end < n:
                before[end] = i
                if (r := rank.get(text[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if (h := before[i]) >= 0 and (r := rank.get(text[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        return count

    def count(self, text: str) -> int:
        """Tokens of a whole text. It is cut before each run of blanks, which no piece can span."""
        if not text:
            return 0
        text = self.prefix + text.replace(" ", BLANK)
        parts = text.split(BLANK)
        total = self.stretch[parts[0]] if parts[0] else 0
        blanks = 0
        memo = self.stretch
        for part in parts[1:]:
            blanks += 1
            if part:
                total += memo[BLANK * blanks + part]
                blanks = 0
        return total + (memo[BLANK * blanks] if blanks else 0)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of documents.

    Null text counts as empty: no bytes, no tokens; texts of any length are counted whole; repeated rows and
    null doc_id stay; an empty table gives no rows; other columns are ignored.
    """

    def make() -> Callable[[list], dict]:
        counter = PieceCounter(path or default_path("piece_bpe_32k.model"))

        def work(batch: list) -> dict:
            counts = [counter.count(t or "") for t in batch]
            return {"n_bytes": [len((t or "").encode()) for t in batch], "n_tokens": counts, "over_limit": [c > limit for c in counts]}

        return work

    return map_texts(texts(docs), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count by piece_bpe_32k.model."""
    return token_counts(documents(spark, sf_dir))

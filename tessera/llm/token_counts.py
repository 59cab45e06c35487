"""Token counts of documents under a unigram vocabulary, without tokenizing each word again.

A pre-token is a run of non-blanks behind a word mark. Its tokens are the split
into pieces with the highest sum of scores (of equal ones, that with fewest
tokens); a character outside the vocabulary counts as its UTF-8 bytes, each at
``UNKNOWN`` below the worst score.

The distinct pre-tokens of a group of documents are walked in sorted order, which
is the depth-first order of their trie: the best score and count of each node
(a prefix) is computed once, on a stack as deep as the trie, and whatever shares
the prefix starts from there. The count at the end of a pre-token is stored; up
to ``KEEP`` of them, of up to ``LONGEST`` characters, stay for later groups. No
shuffle; memory is bounded by KEEP and by the group.

A null text has no tokens. Each input row gets one row. Other columns are ignored.
"""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import DataFrame

from tessera.llm.chunk_encoder import give_back, slices

MARK, UNKNOWN, KEEP, LONGEST = "▁", 10.0, 400_000, 64


class Unigram:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.unknown = min(scores.values()) - UNKNOWN
        self.ends: dict = {}  # the pieces from their last character on; a piece's score at ""
        for piece, score in scores.items():
            node = self.ends
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score

    @classmethod
    def of_model(cls, path: str) -> Unigram:
        """The pieces and scores of a sentencepiece model, without control, unknown, unused and byte pieces."""
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        return cls({m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i))})

    def counts(self, words) -> dict[str, int]:
        """The number of tokens of each of the words; the words form one trie."""
        out, ends, unknown = {}, self.ends, self.unknown
        best, n, before = [0.0], [0], ""
        for word in sorted(words):
            said = MARK + word
            shared = len(commonprefix((before, said)))
            del best[shared + 1 :], n[shared + 1 :]
            for i in range(shared, len(said)):
                top, fewest, node, j = None, 0, ends, i
                while j >= 0 and (node := node.get(said[j])) is not None:
                    if "" in node:
                        score = best[j] + node[""]
                        if top is None or score > top or score == top and n[j] + 1 < fewest:
                            top, fewest = score, n[j] + 1
                    j -= 1
                if said[i] not in self.scores:
                    size = len(said[i].encode("utf-8", "surrogatepass"))
                    if top is None or best[i] + size * unknown > top:
                        top, fewest = best[i] + size * unknown, n[i] + size
                best.append(top)
                n.append(fewest)
            out[word], before = n[-1], said
        return out


_MODELS: dict[str, tuple[Unigram, dict[str, int]]] = {}


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for documents (doc_id, text)."""

    def run(batches):
        import pyarrow as pa

        if model not in _MODELS:
            _MODELS[model] = Unigram.of_model(model), {}
        unigram, known = _MODELS[model]
        for batch in batches:
            for ids, texts in slices(batch, 16_000_000):
                words = [t.split() for t in texts]
                missing = set().union(*words) - known.keys()
                if len(known) + len(missing) > KEEP:
                    known.clear()
                    missing = set().union(*words)
                counted = unigram.counts(missing)
                long = [w for w in counted if len(w) > LONGEST]
                known |= counted
                get = known.__getitem__
                columns = ids, [len(w) for w in words], [sum(map(get, w)) for w in words]
                for word in long:
                    del known[word]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "n_pretokens", "n_tokens"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")

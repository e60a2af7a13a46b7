"""Encoding of whole texts with a public tokenizer, fast where words repeat.

A text is cut before each space or line feed that a non-space follows. The splitting pattern of these
vocabularies starts a new match at every such place, so ids of the pieces, in order, are the ids of the text.
Each distinct piece is encoded once by the library and then looked up; texts are cut, and their ids put together,
column-wise. Texts with other runs of white space, or that hold the string of a special token, which the library then
gives its own id, are encoded whole. The table of pieces is bounded; a full one loses its later half, as frequent
pieces come early.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterable, Iterator

#: Distinct pieces that a worker keeps at most.
TABLE_PIECES = 500_000
#: Characters that one call encodes at most, but for a single longer text; the library takes more at once.
BATCH_CHARS, LIBRARY_BATCH_CHARS = 1_000_000, 2_000_000
#: Texts that are handed to the library as one when pieces are joined.
JOINED = 1024


class Pieces:
    """Ids of pieces end to end, where each ends, and which places of a text may not be cut. All columns, so that a worker
    holds many pieces in little memory."""

    def __init__(self):
        import numpy as np
        import pyarrow as pa

        self.ends, self.ids, self.uncut = np.zeros(1, np.int64), b"", np.zeros(0, bool)
        #: Keys and their rows: of what follows a space or starts with a line feed, and of what starts a text.
        self.known = {kind: (pa.array([], pa.large_string()), np.zeros(0, np.int64)) for kind in (TAIL, HEAD)}

    def __len__(self) -> int:
        return len(self.uncut)

    def rows(self, kind: int, keys, learn):
        """The rows of distinct ``keys``; ``learn`` gives (ids, uncut) of those that are not known yet."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        have, places = self.known[kind]
        at = pc.fill_null(pc.index_in(keys, have), -1).to_numpy()
        rows, lacking = (places[at] if len(places) else np.zeros(len(at), np.int64)), at < 0
        if lacking.any():
            new, n = keys.filter(pa.array(lacking)), len(self)
            found, uncut = learn(new.to_pylist())
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))))
            self.ids += b"".join(found)
            self.uncut = np.concatenate((self.uncut, uncut))
            rows[lacking] = np.arange(n, n + len(found))
            self.known[kind] = (pa.concat_arrays([have, new]), np.concatenate((places, rows[lacking])))
        return rows

    def trim(self, most: int) -> None:
        import pyarrow as pa

        if len(self) > most:
            half = len(self) // 2
            self.known = {kind: (keys.filter(pa.array(rows < half)), rows[rows < half]) for kind, (keys, rows) in self.known.items()}
            self.ends, self.uncut = self.ends[: half + 1].copy(), self.uncut[:half].copy()
            self.ids = self.ids[: self.ends[-1]]

    def joined(self, rows):
        """(bytes of the pieces ``rows`` one after the other, where each begins and the last ends)."""
        import numpy as np
        import pyarrow as pa

        table = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(self.ends), pa.py_buffer(self.ids)])
        taken = table.take(pa.array(rows))
        _, ends, ids = taken.buffers()
        return ids.to_pybytes() if ids else b"", np.frombuffer(ends, np.int64, len(rows) + 1, taken.offset * 8)


TAIL, HEAD = 0, 1


class PieceEncoder:
    """``encode_many`` gives the ids of each string as bytes; ``encode_pieces``, the same for strings of which each may follow
    any other without a change of its ids; ``special`` are the strings that may not be given in parts."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], encode_pieces: Callable[[list[str]], list[bytes]] | None = None, most: int = TABLE_PIECES, special: tuple[str, ...] = ()):
        self.encode_many, self.encode_pieces, self.most, self.special = encode_many, encode_pieces or encode_many, most, special
        self.pieces = Pieces()

    def _tails(self, words: list[str]):
        """Words that stand after a space, or with a line feed of their own: those that other white space begins have no ids."""
        import numpy as np

        uncut = np.array([(not k or k[0].isspace()) and not (len(k) > 1 and k[0] == "\n" and not k[1].isspace()) for k in words], bool)
        found = iter(self.encode_pieces([k if k[0] == "\n" else f" {k}" for k, u in zip(words, uncut, strict=True) if not u]))
        return [b"" if u else next(found) for u in uncut], uncut

    def _heads(self, words: list[str]):
        import numpy as np

        return self.encode_many(words), np.zeros(len(words), bool)

    def encode(self, texts: list[str]) -> list[bytes]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not texts:
            return []
        self.pieces.trim(self.most)
        column = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        cuts, words = column.offsets.to_numpy(), column.flatten()
        tails, heads = words.dictionary_encode(), words.take(pa.array(cuts[:-1])).dictionary_encode()
        rows = self.pieces.rows(TAIL, tails.dictionary, self._tails)[tails.indices.to_numpy()]
        rows[cuts[:-1]] = self.pieces.rows(HEAD, heads.dictionary, self._heads)[heads.indices.to_numpy()]
        whole = np.logical_or.reduceat(self.pieces.uncut[rows], cuts[:-1]).tolist()
        ids, ends = self.pieces.joined(rows)
        at = ends[cuts].tolist()
        return [self.encode_many([t])[0] if w or any(s in t for s in self.special) else ids[a:b] for t, w, a, b in zip(texts, whole, at, at[1:], strict=False)]


@functools.lru_cache(maxsize=4)
def library_encoder(path: str) -> tuple[PieceEncoder, int]:
    """Encoder by the tokenizers library for the vocabulary file ``path``, and its bytes an id. One per worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
    kind = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
    names = sorted(tokenizer.get_vocab().items(), key=lambda x: x[1])
    n_bytes = np.zeros(names[-1][1] + 1, np.int64)  # a byte-level token has a character for each byte
    n_bytes[[i for _, i in names]] = [len(name) for name, _ in names]

    def encode_many(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, kind).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def encode_pieces(texts: list[str]) -> list[bytes]:
        """Joined, and told apart by the bytes that the ids stand for, which is faster; one by one if these do not add up."""
        found = []
        for at in range(0, len(texts), JOINED):
            part = texts[at : at + JOINED]
            ids = np.array(tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, kind)
            ends = np.cumsum(n_bytes[ids])
            wanted = np.cumsum([len(t.encode()) for t in part])
            places = np.searchsorted(ends, wanted)
            if len(ends) and ends[-1] == wanted[-1] and (ends[places] == wanted).all():
                raw = ids.tobytes()
                cuts = [0, *((places + 1) * kind.itemsize).tolist()]
                found += [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            else:
                found += encode_many(part)
        return found

    return PieceEncoder(encode_many, encode_pieces, special=special), kind.itemsize


def in_batches(rows: Iterable[tuple], text_at: int, most: int = BATCH_CHARS) -> Iterator[list[tuple]]:
    """Lists of rows whose texts have ``most`` characters together, or single rows with longer ones."""
    batch, chars = [], 0
    for row in rows:
        size = len(row[text_at])
        if batch and chars + size > most:
            yield batch
            batch, chars = [], 0
        batch.append(row)
        chars += size
    if batch:
        yield batch

"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised as the model says (white space to U+2581, one before the text) and cut where no piece can reach across.
In each part, adjacent symbol pairs that are pieces make an agenda ordered by score, then place; the best is merged until
none is left, and symbols that are no piece become their bytes. The agendas of many parts are worked off together as
arrays; long parts and rare characters take a heap. Parts met before are looked up. All other parts of an Arrow batch, and its
shortest whole text, are encoded by the sentencepiece library too; a difference stops the job.

Defined results: a null text is empty; an empty text has the end id alone; repeated rows are encoded one by one.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Parts remembered by a Python worker (some 180 MB): the first it meets. The others are encoded anew in each batch.
REMEMBERED = 600_000
#: Longer parts have a heap of their own and are not remembered.
LONGEST = 64
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

_codecs: dict[str, Codec] = {}


class Codec:
    """Own encoder and decoder of one model, with the library's processor to check against."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        kinds = {piece.type for piece in model.pieces}
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p.piece) for p in model.pieces if p.type == NORMAL)
        if train.model_type != 2 or not train.byte_fallback or not plain or crossing or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("only merge-type models with byte fallback and plain normalisation are supported")
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == BYTE}
        self.end = self.library.eos_id()
        self.spell = {k: p for p, k in self.ids.items()}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        reached = {c for p in self.ids for c in p}
        # White space runs start a part; a line end, if no piece has one, is a part of its own.
        lone = "" if "\n" in reached else "\n"
        self.parts = re.compile(f"{SPACE}+[^{SPACE}{lone}]*|[^{SPACE}{lone}]+" + (f"|{lone}" if lone else ""))
        self.known: dict[str, tuple[int, bytes, bytes]] = {}
        # For arrays: piece of each character, and the piece that each pair of pieces makes.
        size = len(model.pieces)
        self.char = np.full(0x110000, -1, dtype=np.int32)
        self.score = np.full(size + 1, -np.inf, dtype=np.float32)  # as the model file has them
        pairs = {}
        for piece, k in self.ids.items():
            self.score[k] = self.scores[piece]
            if len(piece) == 1:
                self.char[ord(piece)] = k
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * size + right] = k
        self.size = size
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.pairs.tolist()], dtype=np.int32)
        self.digits = [str(k).encode() for k in range(size)]
        self.said = {k: p.replace(SPACE, " ").encode() for p, k in self.ids.items()}

    def normalised(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def encode_part(self, part: str) -> list[int]:
        """Merge by score; of equal scores the leftmost pair goes first."""
        symbols = list(part)
        if len(symbols) > 1:
            scores = self.scores
            after = list(range(1, len(symbols) + 1))
            before = list(range(-1, len(symbols) - 1))
            agenda = []

            def offer(left, right):
                merged = symbols[left] + symbols[right]
                score = scores.get(merged)
                if score is not None:
                    heapq.heappush(agenda, (-score, left, right, merged))

            for k in range(len(symbols) - 1):
                offer(k, k + 1)
            while agenda:
                _, left, right, merged = heapq.heappop(agenda)
                if symbols[left] is None or symbols[right] is None or symbols[left] + symbols[right] != merged or after[left] != right:
                    continue
                symbols[left], symbols[right] = merged, None
                after[left] = after[right]
                if after[left] < len(symbols):
                    before[after[left]] = left
                    offer(left, after[left])
                if before[left] >= 0:
                    offer(before[left], left)
        ids = []
        for symbol in symbols:
            if symbol is None:
                continue
            own = self.ids.get(symbol)
            if own is not None:
                ids.append(own)
            else:
                ids.extend(self.bytes[b] for b in symbol.encode("utf-8", "surrogatepass"))
        return ids

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that each pair makes, ``size`` where it makes none."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], self.size)

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        """``encode_part`` of each, with the agendas of parts of like length in one array."""
        out: list = [None] * len(parts)
        lengths = np.array([len(p) for p in parts], dtype=np.int64)
        low = 0
        for high in (6, 12, 24, LONGEST):
            chosen = np.flatnonzero((lengths > low) & (lengths <= high))
            low = high
            if not len(chosen):
                continue
            own = lengths[chosen]
            code = np.frombuffer("".join([parts[k] for k in chosen]).encode("utf-32-le"), dtype=np.uint32)
            inside = np.arange(high) < own[:, None]
            symbols = np.full((len(chosen), high), -1, dtype=np.int32)
            symbols[inside] = self.char[code]
            whole = ((symbols >= 0) == inside).all(axis=1)
            for k, row, n in self._merge(symbols[whole], own[whole], chosen[whole]):
                out[k] = row[:n]
        return [self.encode_part(part) if ids is None else ids for part, ids in zip(parts, out, strict=True)]

    def _merge(self, symbols: np.ndarray, lengths: np.ndarray, names: np.ndarray):
        """Work off the agendas of all rows, one merge of each row at a time; yields name, ids, and how many count."""
        joined = self._joined(symbols[:, :-1], symbols[:, 1:])
        place = np.arange(symbols.shape[1])
        while len(symbols):
            rows = np.arange(len(symbols))
            best = np.argmax(self.score[joined], axis=1)  # the leftmost of equal scores
            made = joined[rows, best]
            done = made == self.size
            if done.any():
                yield from zip(names[done].tolist(), symbols[done].tolist(), lengths[done].tolist(), strict=True)
                left = ~done
                symbols, joined, lengths, names, best, made = symbols[left], joined[left], lengths[left], names[left], best[left], made[left]
                rows = np.arange(len(symbols))
                if not len(symbols):
                    return
            lengths = lengths - 1
            width = max(int(lengths.max()), 2)  # no row has more symbols left
            symbols[rows, best] = made
            symbols = np.where(place[:width] <= best[:, None], symbols[:, :width], _shifted(symbols, width, -1))
            joined = np.where(place[: width - 1] < best[:, None], joined[:, : width - 1], _shifted(joined, width - 1, self.size))
            right, left = np.flatnonzero(best < width - 1), np.flatnonzero(best > 0)
            after, before = symbols[right, best[right] + 1], symbols[left, best[left] - 1]
            new = self._joined(np.concatenate([made[right], before]), np.concatenate([after, made[left]]))
            joined[right, best[right]] = new[: len(right)]
            joined[left, best[left] - 1] = new[len(right) :]

    def decode(self, ids: list[int]) -> str:
        """Text of ``ids``: pieces on end, runs of byte ids as UTF-8, less the one space put before the text."""
        out, held = [], bytearray()
        for k in [*ids, None]:
            if k in self.byte_of:
                held.append(self.byte_of[k])
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if k is not None and k in self.spell:
                out.append(self.spell[k])
        text = "".join(out)
        return text.removeprefix(SPACE).replace(SPACE, " ")

    def learn(self, parts: list[str]) -> dict[str, tuple[int, bytes, bytes]]:
        """Number of ids, ids in decimal, and text of each part, compared with the library."""
        # The library puts a space before a text, so a part without one is asked after a line end.
        asked = [p[1:].replace(SPACE, " ") if p[0] == SPACE else "\n" + p for p in parts]
        skipped = len(self.library.encode("\n"))
        out = {}
        digit, say = self.digits.__getitem__, self.said.__getitem__
        for part, own, text, theirs in zip(parts, self.encode_parts(parts), asked, self.library.encode(asked), strict=True):
            if text and own != (theirs if part[0] == SPACE else theirs[skipped:]):
                raise ValueError(f"ids of {part!r} differ from the library's: {own} and {theirs}")
            try:
                said = b"".join(map(say, own))
            except KeyError:  # bytes
                said = self._spelled(own).encode()
            out[part] = len(own), b" ".join(map(digit, own)), said
        return out

    def _spelled(self, ids: list[int]) -> str:
        return self.decode([self.ids[SPACE], *ids])

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text the number of ids, the SHA-256 of the ids and that of the decoded text."""
        cut = [self.parts.findall(self.normalised(t)) for t in texts]
        self._check(min((t for t in texts if t), key=len, default=""))
        new = {p for parts in cut for p in parts}.difference(self.known)
        known = self.known
        if new:
            found = self.learn(list(new))
            if len(known) + len(found) <= REMEMBERED:
                known.update((p, f) for p, f in found.items() if len(p) <= LONGEST)
        rest = found if new else {}
        end = self.digits[self.end]
        out = []
        for parts in cut:
            found = [known.get(p) or rest[p] for p in parts]
            ids = [f[1] for f in found]
            ids.append(end)
            text = b"".join([f[2] for f in found]).removeprefix(b" ")
            out.append((
                sum([f[0] for f in found]) + 1, hashlib.sha256(b" ".join(ids)).hexdigest(), hashlib.sha256(text).hexdigest()
            ))
        return out

    def encode(self, text: str) -> list[int]:
        return [k for part in self.parts.findall(self.normalised(text)) for k in self.encode_part(part)] + [self.end]

    def _check(self, text: str) -> None:
        own = self.encode(text)
        if own != self.library.encode(text, add_eos=True) or self.decode(own) != self.library.decode(own):
            raise ValueError(f"encoding of {text[:200]!r} differs from the library's")


def _shifted(rows: np.ndarray, width: int, empty: int) -> np.ndarray:
    """``width`` columns of ``rows`` from the second on."""
    moved = rows[:, 1 : width + 1]
    return moved if moved.shape[1] == width else np.concatenate([moved, np.full((len(rows), 1), empty, dtype=rows.dtype)], axis=1)


def _utf8(held: bytes) -> str:
    """Each byte that belongs to no character becomes U+FFFD."""
    out, k = [], 0
    while k < len(held):
        for size in (1, 2, 3, 4):
            try:
                out.append(held[k : k + size].decode("utf-8"))
                k += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            k += 1
    return "".join(out)


def codec(path: str) -> Codec:
    """The codec of a model file, one for each Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the installed public tokenizers; every machine has its own copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(documents: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every row; ``model`` names a file or installed vocabulary."""

    def encoded(batches):
        own = codec(model if "/" in model else tokenizer_path(model))
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                rows = own.digests([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([r[0] for r in rows], type=pa.int64()), pa.array([r[1] for r in rows], type=pa.string()),
                     pa.array([r[2] for r in rows], type=pa.string())],
                    names=[doc_id, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(doc_id, F.col(text).cast("string")).mapInArrow(
        encoded, f"`{doc_id}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )

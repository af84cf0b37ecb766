"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The vocabulary given here is a BPE model, whose encoding isn't the path of the best sum of
scores: its result is the one path on which every two neighbouring pieces stay apart when the
merges are run on the two of them. The search is Viterbi's all the same: the state of a boundary
is the last piece of the path that ends there, and a boundary's state follows from those at most
one piece length before it. The encoder keeps these boundaries and their backpointers only, and
commits ids as soon as all paths that survive in the window meet in one boundary. Every segment of a
text goes through it; results of short segments, and states near segments' beginnings, are remembered.
Results equal the sentencepiece library's.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece.sentencepiece_model_pb2 import ModelProto

from chirplake.llm.batches import map_texts

BLANK = "▁"
#: Segments that a worker remembers; then it starts anew.
MEMO = 150_000
#: Longer segments aren't remembered, and states farther from a segment's beginning aren't shared.
MEMO_CHARS = 48
SHARED_CHARS = 6
#: Characters between two looks for a common boundary.
COMMIT_EVERY = 64
#: In place of an id: a piece that wasn't looked at yet, and one that no merges make.
UNTRIED, NEVER = -(1 << 40), -(1 << 41)
#: From here on pieces share one rank.
SHARED_RANK = 1e8
INNER_BLANK = re.compile(f"[^{BLANK}]{BLANK}")
SEGMENT = re.compile(f"{BLANK}*[^{BLANK}]*")


def checked(model: bytes) -> bytes:
    """The model, if its ids are what this search gives; ValueError for another kind, normaliser or white-space rule."""
    m = ModelProto()
    m.ParseFromString(model)
    t, n = m.trainer_spec, m.normalizer_spec
    wrong = [
        *(["its type is not BPE"] if t.model_type != t.BPE else []),
        *(["it has no byte fallback"] if not t.byte_fallback else []),
        *(["white space is a suffix"] if t.treat_whitespace_as_suffix else []),
        *(["its normaliser changes characters"] if n.precompiled_charsmap else []),
        *(["it removes or does not escape white space, or adds no blank in front"] if n.remove_extra_whitespaces or not n.escape_whitespaces or not n.add_dummy_prefix else []),
        *(["its pieces go over white space"] if not t.split_by_whitespace or any(p.type == p.NORMAL and INNER_BLANK.search(p.piece) for p in m.pieces) else []),
        *(["it has pieces of the user's own"] if any(p.type == p.USER_DEFINED for p in m.pieces) else []),
    ]
    if wrong:
        raise ValueError(f"a SentencePiece model that this encoder can't follow: {'; '.join(wrong)}")
    return model


class Vocabulary:
    """Pieces of a BPE model with byte fallback. Characters without a piece have negative ids here, and become bytes in the output."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=checked(model))
        n = sp.get_piece_size()
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        self.out: list[bytes] = [b""] * n
        for k in range(n):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.byte[int(piece[3:5], 16)] = k
                self.out[k] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)):
                self.id[piece], self.rank[piece] = k, sp.get_score(k)
                self.out[k] = piece.replace(BLANK, " ").encode()
        self.longest = max(map(len, self.id), default=1)
        ends: dict[str, set[int]] = {}
        for piece in self.id:
            if len(piece) > 2:
                ends.setdefault(piece[-3:], {2, 1}).add(len(piece))
        self.lengths = {end: tuple(sorted(n, reverse=True)) for end, n in ends.items()}  # of the pieces that end with these three characters
        self.text = {k: p for p, k in self.id.items()}
        self.chars = {k: len(p) for p, k in self.id.items()}
        sizes = np.array([len(b) for b in self.out], np.int64)
        self.out_bytes, self.out_sizes, self.out_starts = np.frombuffer(b"".join(self.out), np.uint8), sizes, np.cumsum(sizes) - sizes
        self._apart: dict[int, bool] = {}
        self._edges: tuple[dict, dict] = ({}, {})
        self.known: dict[str, int] = dict.fromkeys(self.id, UNTRIED)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.states: dict[str, tuple[int, ...]] = {}
        self.encoder = StreamingEncoder(self)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by its merges, best score first and leftmost among equals."""
        parts = list(text)
        while True:
            best = max(((self.rank[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def piece(self, text: str) -> int:
        """The id of a piece that can come about by merges, else NEVER; a character's own where it has no piece."""
        k = self.id.get(text, -ord(text[0]) - 1)
        if len(text) > 1 and self.merged(text) != [text]:
            k = NEVER
        self.known[text] = k
        return k

    def name(self, k: int) -> str:
        return self.text[k] if k >= 0 else chr(-k - 1)

    def size(self, k: int) -> int:
        return self.chars[k] if k >= 0 else 1

    def _edge(self, k: int, right: bool) -> list[tuple[str, float, float]] | None:
        """The pieces that stand at one edge of a piece while it is merged, each with the rank by which it is there and the one by which it is merged on.

        Ranks grow with time; None for pieces whose ranks others share.
        """
        found = self._edges[right].get(k, 0)
        if found == 0:
            name, found, end = self.name(k), [], float("inf")
            while len(name) > 1 and found is not None:
                born = -self.rank[name]
                if born >= SHARED_RANK:
                    found = None
                    break
                found.append((name, born, end))
                parts = self._halves(name)
                name, end = parts[1] if right else parts[0], born
            if found is not None:
                found.append((name, -1.0, end))
            self._edges[right][k] = found
        return found

    def _halves(self, name: str) -> list[str]:
        """The two pieces of which the last merge makes this one."""
        parts = list(name)
        while len(parts) > 2:
            best = max((self.rank[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank)
            parts[-best[1] : 2 - best[1]] = ["".join(parts[-best[1] : 2 - best[1]])]
        return parts

    def apart(self, left: int, right: int) -> bool:
        """Whether the two pieces stay as they are side by side: no two pieces at their edges that stand at the same time merge before one of them is merged on."""
        if len(self._apart) > 2 * MEMO:
            self._apart.clear()
        us, vs = self._edge(left, True), self._edge(right, False)
        if us is None or vs is None:
            a, b = self.name(left), self.name(right)
            stays = self.merged(a + b) == [a, b]
        else:
            stays = True
            for u, born_u, end_u in us:
                for v, born_v, end_v in vs:
                    if born_u < end_v and born_v < end_u:
                        rank = self.rank.get(u + v)
                        # Of equal merges the left one is first.
                        if rank is not None and -rank < end_u and -rank <= end_v:
                            stays = False
        self._apart[(left << 32) + right] = stays  # ids are within 32 bits, characters' negative ones too
        return stays

    def ids(self, pieces: list[int]) -> list[int]:
        if not pieces or min(pieces) >= 0:
            return pieces
        out: list[int] = []
        for k in pieces:
            if k >= 0:
                out.append(k)
            else:
                out += [self.byte[b] for b in chr(-k - 1).encode("utf-8", "surrogatepass")]
        return out


def _search(v: Vocabulary, chars: str, begin: int, last: list, before: int | None) -> None:
    """Adds the states of the boundaries behind begin: of each the one piece that may stand last.

    The states near a segment's beginning are a function of its first characters, so that segments share them by v.states.
    """
    known, apart, lengths = v.known.get, v._apart.get, v.lengths.get
    head = chars[:SHARED_CHARS] if before is None and not begin else None
    if head:
        last += v.states.get(head, ())
        begin = len(last) - 1
    for end in range(begin + 1, len(chars) + 1):
        for n in lengths(chars[end - 3 : end] if end > 2 else "", (2, 1)):
            start = end - n
            if start < 0:
                continue
            k = known(chars[start:end])
            if k is None:
                if start < end - 1:
                    continue
                k = v.piece(chars[start])
            elif k == UNTRIED:
                k = v.piece(chars[start:end])
            if k == NEVER:
                continue
            left = last[start] if start else before
            if left is None:
                break
            stays = apart((left << 32) + k)
            if stays or stays is None and v.apart(left, k):
                break
        else:
            raise ValueError("no path reaches a boundary")
        last.append(k)
    if head and begin < len(head):
        if len(v.states) >= 2 * MEMO:
            v.states.clear()
        v.states[head] = tuple(last[1 : len(head) + 1])


class StreamingEncoder:
    """Takes characters (blanks as the model's blank sign) and gives ids as they become certain."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.chars = ""  # those of the window and of what isn't committed
        self.last: list[int | None] = [None]  # last piece of the path to each boundary of chars
        self.before: int | None = None  # the piece before chars, committed

    def feed(self, text: str) -> list[int]:
        if len(text) + len(self.chars) < COMMIT_EVERY:
            self._extend(text)
            return []
        out: list[int] = []
        for k in range(0, len(text), COMMIT_EVERY):
            self._extend(text[k : k + COMMIT_EVERY])
            if len(self.chars) >= COMMIT_EVERY:
                out += self._commit(self._common())
        return out

    def finish(self) -> list[int]:
        out = self._commit(len(self.chars))
        self.before = None
        return out

    def _extend(self, text: str) -> None:
        v, begin = self.v, len(self.chars)
        self.chars += text
        _search(v, self.chars, begin, self.last, self.before)

    def _back(self, at: int) -> int:
        return at - self.v.size(self.last[at])

    def _common(self) -> int:
        """The last boundary that the paths to all boundaries within reach of the next piece have in common."""
        open_ = set(range(max(0, len(self.chars) - self.v.longest + 1), len(self.chars) + 1))
        while len(open_) > 1:
            most = max(open_)
            open_.remove(most)
            open_.add(self._back(most))
        return open_.pop()

    def _commit(self, upto: int) -> list[int]:
        path, last, sizes, at = [], self.last, self.v.chars, upto
        while at > 0:
            k = last[at]
            path.append(k)
            at -= sizes[k] if k >= 0 else 1
        path.reverse()
        if path:
            self.before = path[-1]
        self.chars, self.last = self.chars[upto:], [None, *last[upto + 1 :]]
        return self.v.ids(path)


def encode_segment(v: Vocabulary, segment: str) -> tuple[int, ...]:
    """Ids of a segment on whose two sides all paths meet, remembered unless it is long."""
    found = v.memo.get(segment)
    if found is None:
        found = tuple(v.encoder.feed(segment) + v.encoder.finish())
        if len(segment) <= MEMO_CHARS:
            if len(v.memo) >= MEMO:
                v.memo.clear()
            v.memo[segment] = found
    return found


def encode_word(v: Vocabulary, word: str) -> tuple[int, ...]:
    """Ids of a blank sign and a word that has none; a line break has no piece, and all paths meet on both its sides."""
    if "\n" not in word or "\n" in v.id:
        return encode_segment(v, BLANK + word)
    out: list[int] = []
    for k, part in enumerate(word.split("\n")):
        if k:
            out += encode_segment(v, "\n")
        if part or not k:
            out += encode_segment(v, part if k else BLANK + part)
    return tuple(out)


def encode_text(v: Vocabulary, text: str) -> list[int]:
    """Ids of a whole text. No piece has a blank behind another character, so that all paths meet before a run of blanks."""
    if not text:
        return []
    return [k for m in SEGMENT.finditer(BLANK + text.replace(" ", BLANK)) if m[0] for k in encode_segment(v, m[0])]


def decode_ids(v: Vocabulary, ids: list[int]) -> str:
    """The text; bytes that are no UTF-8 become the replacement sign, and the first blank goes."""
    return b"".join([v.out[k] for k in ids]).removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def encode_all(v: Vocabulary, texts: pa.Array) -> pa.ListArray:
    """Ids of each text, null for null. Distinct words are encoded once a piece of rows; texts with runs of blanks go segment by segment."""
    plain = pc.fill_null(pc.match_substring_regex(texts, f"^ |  | $|{BLANK}|^$"), False)
    odd = set(np.flatnonzero(plain.to_numpy(zero_copy_only=False)).tolist())
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    words, parents = pc.list_flatten(lists).dictionary_encode(), pc.list_parent_indices(lists).to_numpy()
    coded = [encode_word(v, w) if BLANK not in w else () for w in words.dictionary.to_pylist()]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    flat = np.fromiter(chain.from_iterable(coded), np.int32, int(sizes.sum()))
    use = words.indices.to_numpy()
    n = sizes[use]
    ends = np.cumsum(n)
    ids = flat[np.repeat(starts[use] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
    lengths = np.bincount(parents, weights=n, minlength=len(texts)).astype(np.int64)
    missing = texts.is_null().to_numpy(zero_copy_only=False)
    if odd or missing.any():
        rows = np.split(ids, np.cumsum(lengths)[:-1])
        for k in odd:
            rows[k] = np.array(encode_text(v, texts[k].as_py()), np.int32)
        for k in np.flatnonzero(missing):
            rows[k] = np.zeros(0, np.int32)
        lengths, ids = np.array([len(r) for r in rows]), np.concatenate(rows)
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)), mask=pa.array(missing))


def round_trips(v: Vocabulary, texts: pa.Array, ids: pa.ListArray) -> pa.Array:
    """Whether each text's ids decode to it, all decoded together; null for null."""
    flat = ids.values.to_numpy()
    sizes = v.out_sizes[flat]
    ends = np.cumsum(sizes)
    got = v.out_bytes[np.repeat(v.out_starts[flat] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
    offsets = ids.offsets.to_numpy()
    got_ends = np.concatenate(([0], ends))[offsets]
    wanted = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts.to_pylist()]
    same = np.diff(got_ends) == np.array([len(w) for w in wanted], np.int64)
    raw = got.tobytes()
    out = [bool(s) and raw[a:b] == w for s, a, b, w in zip(same, got_ends[:-1].tolist(), got_ends[1:].tolist(), wanted, strict=True)]
    return pa.array([o if t else None for o, t in zip(out, texts.is_valid().to_pylist(), strict=True)], pa.bool_())


def encode(df: DataFrame, model: bytes, *, text: str = "text", carry: list[str]) -> DataFrame:
    """The carry columns with ids, n_tokens and round_trip: whether decoding the ids gives the text back.

    A null text has null ids, 0 tokens and a null round_trip; an empty one no ids. Only texts that hold
    the model's own blank sign don't come back, as it decodes to a blank. The model file's
    bytes go to the tasks, so that executors need no copy of the file.
    """

    def work(texts: pa.Array) -> dict:
        v = vocabulary(model)
        ids = encode_all(v, texts)
        return {"ids": ids, "n_tokens": pc.fill_null(pc.list_value_length(ids), 0), "round_trip": round_trips(v, texts, ids)}

    kept = [c for c in carry if c.lower() not in ("ids", "n_tokens", "round_trip")]
    return map_texts(df, text, kept, "ids array<int>, n_tokens int, round_trip boolean", work)


def decode(df: DataFrame, model: bytes, *, ids: str = "ids", carry: list[str], out: str = "text") -> DataFrame:
    """The carry columns with the decoded text of the ids column, null for null."""

    def run(batches):
        v = vocabulary(model)
        for batch in batches:
            texts = [None if i is None else decode_ids(v, i) for i in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + [pa.array(texts, pa.string())], [*carry, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in carry)
    return df.select(*carry, df[ids].alias("_ids")).mapInArrow(run, f"{kinds}, `{out}` string" if kinds else f"`{out}` string")

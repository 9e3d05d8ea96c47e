"""A unigram piece model: a double-array trie of pieces with log scores, and forward scores over a trie of pre-tokens."""

from __future__ import annotations

import math
import struct
from array import array
from collections.abc import Iterator

import numpy as np

MARK = "▁".encode()
#: Added to the least piece score for a character that no piece covers.
UNKNOWN_PENALTY = 10.0
#: A pre-token of more bytes is walked alone: in a shared trie its branch would have one word, a level for each byte.
LONG = 64
#: Bytes of a long pre-token that are looked up in the piece trie at once.
WALK_BYTES = 1 << 15
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, varint()
            continue
        n = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, kind, data[at : at + n]
        at += n


def read_pieces(model: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a serialized SentencePiece model."""
    out = []
    for number, kind, value in _fields(model):
        if number == 1 and kind == 2:
            piece, score, of = "", 0.0, NORMAL
            for n, k, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2 and k == 5:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    of = v
            out.append((piece, score, of))
    return out


def zipf_scores(pieces: list[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """Log scores by Zipf's law over the order of the scores, for vocabularies whose scores are merge ranks."""
    normal = [i for i, (_, _, of) in enumerate(pieces) if of in (NORMAL, USER)]
    order = sorted(normal, key=lambda i: (-pieces[i][1], i))
    total = math.log(sum(1 / (r + 1) for r in range(len(order))) or 1)
    rank = {i: -math.log(r + 1) - total for r, i in enumerate(order)}
    return [(p, rank.get(i, s), of) for i, (p, s, of) in enumerate(pieces)]


class Model:
    """Pieces in a double-array trie over bytes: from state s with byte b to base[s] + b, if check there is s."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.pieces = [p.encode() for p, _, _ in pieces]
        self.score = np.array([s for _, s, _ in pieces], dtype=np.float64)
        self.kinds = [of for _, _, of in pieces]
        self.byte_id = np.full(256, -1, dtype=np.int64)
        for i, (p, _, of) in enumerate(pieces):
            if of == BYTE:
                self.byte_id[int(p[3:5], 16)] = i
        self.unknown = next((i for i, of in enumerate(self.kinds) if of == UNKNOWN), 0)
        self.fallback = bool((self.byte_id >= 0).all())
        normal = {p: i for i, (p, of) in enumerate(zip(self.pieces, self.kinds)) if of in (NORMAL, USER) and p}
        self.unknown_score = float(min((self.score[i] for i in normal.values()), default=0.0)) - UNKNOWN_PENALTY
        self.longest = max(map(len, normal), default=1)
        #: No piece goes from another character on to the mark, so pre-tokens that start with it are independent.
        self.splits = not any(MARK in p.decode().lstrip("▁").encode() for p in normal)
        self._build(sorted(normal.items()))
        self.output = [b"" if of in (CONTROL, UNUSED) else bytes([int(p[3:5], 16)]) if of == BYTE else b" \xe2\x81\x87 " if of == UNKNOWN else p.replace(MARK, b" ") for p, of in zip(self.pieces, self.kinds)]

    def _build(self, items: list[tuple[bytes, int]]) -> None:
        base, check, value = [0], [0], [-1]
        used = bytearray([1])
        stack = [(0, 0, 0, len(items))]
        hint = 1
        while stack:
            state, depth, lo, hi = stack.pop()
            if lo < hi and len(items[lo][0]) == depth:
                value[state] = items[lo][1]
                lo += 1
            if lo == hi:
                continue
            edges = []
            for i in range(lo, hi):
                b = items[i][0][depth]
                if not edges or edges[-1][0] != b:
                    edges.append((b, i))
            codes = [b for b, _ in edges]
            # The first free slots are tried; if none takes all children, they go behind the last one.
            hint = used.find(0, hint)
            hint = len(used) if hint < 0 else hint
            slot = max(hint, codes[0] + 1)
            for _ in range(32):
                slot = used.find(0, slot)
                at = slot - codes[0]
                if slot < 0 or not any(used[at + c : at + c + 1] == b"\1" for c in codes):
                    break
                slot += 1
            else:
                slot = -1
            if slot < 0:
                at = max(len(used), codes[0] + 1) - codes[0]
            grow = at + codes[-1] + 1 - len(used)
            if grow > 0:
                used += bytes(grow)
                base += [0] * grow
                check += [-1] * grow
                value += [-1] * grow
            base[state] = at
            for c in codes:
                used[at + c] = 1
                check[at + c] = state
            ends = [i for _, i in edges[1:]] + [hi]
            for (b, i), end in zip(edges, ends):
                stack.append((at + b, depth + 1, i, end))
        base, check, value = (np.array(x, dtype=np.int32) for x in (base, check, value))
        self.base, self.check, self.value = base, check, value


def pretokens(text: bytes, prefix: bool = True, splits: bool = True) -> list[bytes]:
    """The text with spaces as marks, cut before each run of marks: every part is its marks and what follows them.

    splits is the model's: false if pieces go across the cuts, so that the text stays whole.
    """
    if not splits:
        return [(b" " + text if prefix else text).replace(b" ", MARK)] if text else []
    marked = (b" " if prefix and text else b"") + text
    if b"  " not in marked and marked[:1] == b" " and marked[-1:] != b" ":
        return [MARK + x for x in marked[1:].split(b" ")]
    parts = marked.split(b" ")
    out, marks = [parts[0]] if parts[0] else [], 0
    for x in parts[1:]:
        marks += 1
        if x:
            out.append(MARK * marks + x)
            marks = 0
    if marks:
        out.append(MARK * marks)
    return out


class Forward:
    """Best scores of all prefixes of distinct pre-tokens, over the trie of these pre-tokens.

    A node is a prefix that some pre-token has; it is computed once, level by level. active holds, for each node of a
    level, the states of the piece trie that began at its ancestors. Sums are the best over the pieces that end at a
    node; of equal sums the longest piece counts. Counts of tokens and, if asked, piece and start are stored as well.
    """

    def __init__(self, model: Model, words: list[bytes], paths: bool):
        order = sorted(range(len(words)), key=words.__getitem__)
        self.order = np.array(order, dtype=np.int64)
        ordered = [words[i] for i in order]
        n = len(ordered)
        lengths = np.fromiter(map(len, ordered), dtype=np.int64, count=n)
        flat = np.frombuffer(b"".join(ordered) + b"\0", dtype=np.uint8)
        starts = np.r_[0, np.cumsum(lengths)[:-1]] if n else np.zeros(0, np.int64)
        self.lengths, self.tokens, self.best = lengths, np.zeros(n, np.int64), np.zeros(n)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.leaf = np.zeros(n, dtype=np.int64)
        alive = np.flatnonzero(lengths > 0)
        node = np.zeros(len(alive), dtype=np.int64)
        score, count = np.zeros(1), np.zeros(1, np.int64)
        # The states that wait at the nodes of the level, sorted by node: where they began, with that node's sums.
        a_node, a_state, a_score, a_count, a_from = (np.zeros(1, x) for x in (np.int64, np.int64, np.float64, np.int64, np.int64))
        a_from_node = np.zeros(1, np.int64)
        a_pend = np.zeros(1, bool)
        depth = 0
        base, check, value = model.base, model.check, model.value
        low, limit = model.unknown_score, len(model.check)
        while len(alive):
            byte = flat[starts[alive] + depth].astype(np.int64)
            key = node * 256 + byte
            new = np.r_[True, key[1:] != key[:-1]]
            child = np.cumsum(new) - 1
            parent, c_byte = node[new], byte[new]
            m = len(parent)
            first = np.searchsorted(a_node, parent)
            many = np.searchsorted(a_node, parent, "right") - first
            take = np.repeat(first - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(int(many.sum()))
            of = np.repeat(np.arange(m), many)
            b = c_byte[of]
            state = a_state[take]
            going = state >= 0
            to = np.where(going, base[np.maximum(state, 0)] + b, 0)
            ok = going & (to < limit) & (to > 0)
            ok[ok] = check[to[ok]] == state[ok]
            started, begun, begun_count, begun_node = a_from[take], a_score[take], a_count[take], a_from_node[take]
            pend = a_pend[take]
            # A character without a piece: its bytes go through with no state until the character is whole.
            nxt_cont = self._continues(flat, starts, alive, lengths, depth, new)
            char_end = ~nxt_cont
            piece = np.where(ok, value[np.where(ok, to, 0)], -1)
            piece = np.where(char_end[of], piece, -1)
            whole_at = pend & char_end[of]
            cand = np.where(piece >= 0, begun + model.score[np.maximum(piece, 0)], np.where(whole_at, begun + low, -np.inf))
            width = depth + 1 - started
            n_tok = np.where(piece >= 0, 1, width if model.fallback else 1)
            edges = np.r_[0, np.cumsum(many)[:-1]]
            top = np.maximum.reduceat(cand, edges) if len(cand) else np.zeros(0)
            is_top = (cand == top[of]) & np.isfinite(cand)
            at = np.flatnonzero(is_top)
            firsts = at[np.r_[True, of[at][1:] != of[at][:-1]]] if len(at) else at  # states are in order of start: the longest piece
            new_score, new_count = np.full(m, -np.inf), np.zeros(m, np.int64)
            back_piece, back_depth, back_node = np.full(m, -1, np.int64), np.full(m, -1, np.int64), np.full(m, -1, np.int64)
            k = of[firsts]
            new_score[k], new_count[k] = cand[firsts], begun_count[firsts] + n_tok[firsts]
            if paths:
                back_piece[k], back_depth[k], back_node[k] = piece[firsts], started[firsts], begun_node[firsts]
                self.levels.append((back_piece, back_depth, back_node))
            depth += 1
            done = lengths[alive] == depth
            if done.any():
                w = alive[done]
                self.tokens[w], self.best[w], self.leaf[w] = new_count[child[done]], new_score[child[done]], child[done]
            keep = ok | (pend & ~char_end[of])
            # Every state that goes on, and one that begins at each node that ends a character.
            begin = np.flatnonzero(np.isfinite(new_score))
            nodes = np.r_[of[keep], begin]
            sort = np.argsort(nodes, kind="stable")
            a_node = nodes[sort]
            a_state = np.r_[np.where(ok, to, -1)[keep], np.zeros(len(begin), np.int64)][sort]
            a_score = np.r_[begun[keep], new_score[begin]][sort]
            a_count = np.r_[begun_count[keep], new_count[begin]][sort]
            a_from = np.r_[started[keep], np.full(len(begin), depth)][sort]
            a_from_node = np.r_[begun_node[keep], begin][sort]
            a_pend = np.r_[(pend & ~char_end[of])[keep], np.zeros(len(begin), bool)][sort]
            a_pend |= a_from == depth
            left = ~done
            alive, node = alive[left], child[left]

    @staticmethod
    def _continues(flat, starts, alive, lengths, depth, new) -> np.ndarray:
        """Whether the byte after this node's goes on with the same character, by the node's first pre-token.

        All pre-tokens are valid UTF-8, so a lead byte tells how many follow and all words of a node agree.
        """
        w = alive[new]
        inside = lengths[w] > depth + 1
        after = flat[np.minimum(starts[w] + depth + 1, len(flat) - 1)]
        return inside & ((after & 0xC0) == 0x80)

    def pieces(self, model: Model) -> list[list[int]]:
        """The ids of each word's best path, in the order of the given words."""
        n = len(self.lengths)
        out: list[list[int]] = [[] for _ in range(n)]
        node, depth = self.leaf.copy(), self.lengths.copy()
        live = np.flatnonzero(depth > 0)
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            d = depth[live]
            piece, start, parent = np.empty(len(live), np.int64), np.empty(len(live), np.int64), np.empty(len(live), np.int64)
            for level in np.unique(d):
                at = d == level
                bp, bd, bn = self.levels[level - 1]
                nodes = node[live[at]]
                piece[at], start[at], parent[at] = bp[nodes], bd[nodes], bn[nodes]
            steps.append((live, piece, start, d))
            node[live], depth[live] = parent, start
            live = live[start > 0]
        for at, piece, start, end in reversed(steps):
            for w, p, s, e in zip(at.tolist(), piece.tolist(), start.tolist(), end.tolist()):
                out[w].append(p if p >= 0 else -(s << 32 | e) - 1)
        return out


def walk_long(model: Model, word: bytes) -> tuple[array, int]:
    """The best path of one pre-token of any length: (the piece that ends at each byte, -1 for a character without a piece, and the number of its tokens).

    The same sums and choices as Forward, in time and memory that are linear in the bytes: the piece trie is walked from
    all characters of a part at once, then the best scores are pushed on from character to character. Only the pieces
    are kept for the whole pre-token, four bytes for each of its bytes.
    """
    n, reach = len(word), max(model.longest, 4)
    flat = np.frombuffer(word + bytes(reach + 1), dtype=np.uint8)
    pieces = array("i", [-2]) * (n + 1)
    low, limit, score = model.unknown_score, len(model.check), model.score
    best, count = [0.0] + [-math.inf] * reach, [0] * (reach + 1)
    for at in range(0, n, WALK_BYTES):
        size = min(WALK_BYTES, n - at)
        starts = np.flatnonzero((flat[at : at + size] & 0xC0) != 0x80)
        width = np.array([1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 3, 4])[flat[at + starts] >> 4]
        state, live = np.zeros(len(starts), np.int64), np.arange(len(starts))
        owners, lengths, found = [], [], []
        for k in range(model.longest):
            byte = flat[at + starts[live] + k]
            inside = at + starts[live] + k < n
            to = model.base[state[live]] + byte
            ok = inside & (to < limit) & (to > 0)
            ok[ok] = model.check[to[ok]] == state[live][ok]
            live = live[ok]
            if not len(live):
                break
            state[live] = to[ok]
            piece = model.value[state[live]]
            whole = (piece >= 0) & ((flat[at + starts[live] + k + 1] & 0xC0) != 0x80)
            owners.append(live[whole])
            lengths.append(np.full(int(whole.sum()), k + 1))
            found.append(piece[whole])
        none = np.zeros(0, np.int64)
        owners, lengths, found = (np.concatenate([none, *x]) for x in (owners, lengths, found))
        alone = np.ones(len(starts), bool)  # characters that no piece covers by itself
        alone[owners[lengths == width[owners]]] = False
        lost = np.flatnonzero(alone)
        owners, lengths, found = np.r_[owners, lost], np.r_[lengths, width[lost]], np.r_[found, np.full(len(lost), -1)]
        order = np.argsort(owners, kind="stable")
        gain = np.where(found >= 0, score[np.maximum(found, 0)], low)[order].tolist()
        tokens = np.where(found >= 0, 1, lengths if model.fallback else 1)[order].tolist()
        best += [-math.inf] * size
        count += [0] * size
        for a, b, piece, g, t in zip(starts[owners[order]].tolist(), (starts[owners] + lengths)[order].tolist(), found[order].tolist(), gain, tokens):
            s = best[a] + g
            if s > best[b]:  # starts come in order: of equal sums the longest piece stays
                best[b], count[b], pieces[at + b] = s, count[a] + t, piece
        best, count = best[size:], count[size:]
    return pieces, count[0]


def long_ids(model: Model, word: bytes) -> array:
    """The ids of one long pre-token."""
    pieces, n = walk_long(model, word)
    out, end = array("i", [0]) * n, len(word)
    while end:
        piece = pieces[end]
        if piece >= 0:
            n -= 1
            out[n] = piece
            end -= len(model.pieces[piece])
            continue
        start = end - 1
        while word[start] & 0xC0 == 0x80:
            start -= 1
        ids = [int(model.byte_id[x]) for x in word[start:end]] if model.fallback else [model.unknown]
        n -= len(ids)
        out[n : n + len(ids)] = array("i", ids)
        end = start
    return out


def encode_words(model: Model, words: list[bytes]) -> list[list[int]]:
    """The ids of each distinct pre-token; a character without a piece gives its bytes, or the unknown id."""
    found = Forward(model, words, True)
    out: list[list[int]] = [[]] * len(words)
    for i, ids in zip(found.order.tolist(), found.pieces(model)):
        if ids and min(ids) < 0:
            full: list[int] = []
            for x in ids:
                if x >= 0:
                    full.append(x)
                else:
                    part = words[i][(-x - 1) >> 32 : (-x - 1) & 0xFFFFFFFF]
                    full += model.byte_id[list(part)].tolist() if model.fallback else [model.unknown]
            ids = full
        out[i] = ids
    return out


def count_words(model: Model, words: list[bytes]) -> np.ndarray:
    found = Forward(model, words, False)
    out = np.empty(len(words), np.int64)
    out[found.order] = found.tokens
    return out


def decode(model: Model, ids: list[int], prefix: bool = True) -> str:
    """The text of the ids: marks are spaces, byte pieces are joined as UTF-8, each invalid byte is U+FFFD."""
    text = b"".join([model.output[i] for i in ids])
    if prefix and text.startswith(b" "):
        text = text[1:]
    return text.decode("utf-8", "replace")

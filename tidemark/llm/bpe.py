"""Operator 6, BPE encoding and decoding: a backtracking encoder, many words in step.

A sequence of tokens is the BPE encoding of a word exactly when every token
encodes to itself and every adjacent pair is compatible: no merge across the
border would have come before the merges inside the two tokens. One pass of an
Aho-Corasick automaton over a word tells the longest token that ends at each
place; the failure link of a token leads to the next shorter token that ends
there. The encoder goes back from the word's end: it takes the longest match at
a border, asks the pair table whether the token after it may follow, tries the
next shorter match, and takes back the last token where none is left. A border
given up once is never entered again (what stands behind it is the only
encoding of that rest), so the work is linear in the word's length. All
distinct words of an Arrow batch advance together, one NumPy operation a step;
words longer than LOCKSTEP have the same steps in a loop of their own. Decoding
reads token strings through an offset table.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, read_table, small_arrow_batches, span_hashes

LETTER, NUMBER, OTHER, SPACE, SPECIAL = 0, 1, 2, 3, 4
MARK = 0x110000  # code points from here on stand for the added tokens
CONTRACTIONS = (("'", "s"), ("'", "t"), ("'", "r", "e"), ("'", "v", "e"), ("'", "m"), ("'", "l", "l"), ("'", "d"))
NONE = -1
LONG = 400_000  # characters encoded at a time
LOCKSTEP = 64  # bytes of the longest words that advance together
SEGMENT = 192  # places that one walk of the automaton covers, in longer words
#: What a tokenizer file must say for this module to read texts as the file asks.
EXPECTED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}
EXPECTED_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
EXPECTED_ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def check_spec(spec: dict) -> None:
    """Raise ValueError for a tokenizer file that this module would read otherwise than the file says."""
    places = [(spec, EXPECTED), (spec["model"], EXPECTED_MODEL), *((t, EXPECTED_ADDED) for t in spec["added_tokens"])]
    wrong = [k for have, want in places for k, v in want.items() if have.get(k) != v]
    if wrong or not spec["model"].get("end_of_word_suffix"):
        raise ValueError(f"this tokenizer file isn't one of words with an end mark as read here: {', '.join(wrong) or 'end_of_word_suffix'}")


class HashTable:
    """int64 keys to int32 values in open addressing, looked up a whole array at a time; absent keys give -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int32)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == -1
            self.keys[at[left[free]]] = keys[left[free]]  # of keys that want one place the last gets it
            won = self.keys[at[left]] == keys[left]
            self.values[at[left[won]]] = values[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & int(self.mask)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) & self.mask).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        left = np.flatnonzero((found != keys) & (found != -1))
        where = at[left]
        while len(left):
            where = (where + 1) & int(self.mask)
            found = self.keys[where]
            hit = found == keys[left]
            out[left[hit]] = self.values[where[hit]]
            go = ~hit & (found != -1)
            left, where = left[go], where[go]
        return out


def byte_names() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes name themselves, the others take code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of a tokenizers file with BPE, an end-of-word suffix and a byte-level alphabet."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_spec(spec)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        ids: dict[str, int] = model["vocab"]
        self.special = [(t["content"], t["id"]) for t in spec["added_tokens"]]
        size = max([*ids.values(), *(i for _, i in self.special)]) + 1
        names = byte_names()

        def symbols(token: str) -> list[int]:
            body, last = (token.removesuffix(self.suffix), 256) if token.endswith(self.suffix) else (token, 0)
            out = [names[c] for c in body]
            out[-1] += last
            return out

        self.base = np.full(512, NONE, np.int32)
        left, right, rank = (np.full(size, NONE, np.int32) for _ in range(3))
        pairs, made = [], []
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        for r, (a, b) in enumerate(merges):
            t = ids[a + b]
            if rank[t] == NONE:
                left[t], right[t], rank[t] = ids[a], ids[b], r
            pairs.append(ids[a] << 20 | ids[b])
            made.append(r)
        self.merges = (np.array(pairs, np.int64), np.array(made, np.int32))
        self.rank_of_pair = HashTable(*self.merges)
        spelled: dict[int, list[int]] = {}
        for token, t in ids.items():
            if all(c in names for c in token.removesuffix(self.suffix)) and token.removesuffix(self.suffix):
                spelled[t] = symbols(token)
                if len(spelled[t]) == 1:
                    self.base[spelled[t][0]] = t
        # Spines: the tokens that stand at a token's right (left) border while it is built, outermost first, with the rank at which each is swallowed.
        self.right_spine, self.right_until = self._spine(right, rank, size)
        self.left_spine, self.left_until = self._spine(left, rank, size)
        # Tokens that encode to themselves: both halves do, and the halves' border holds until their own merge.
        ok = np.zeros(size, bool)
        ok[[t for t, s in spelled.items() if len(s) == 1]] = True
        order = np.argsort(rank, kind="stable")
        order = order[rank[order] != NONE]
        clear = np.zeros(size, bool)
        clear[order] = self.compatible(left[order], right[order], own=rank[order])
        for t in order.tolist():
            ok[t] = clear[t] and ok[left[t]] and ok[right[t]]
        self._automaton({t: s for t, s in spelled.items() if ok[t]}, size)
        names_of = {i: t for t, i in ids.items()} | {i: t for t, i in self.special}
        self.strings, self.string_at = self._table([names_of.get(i, "") + " " for i in range(size)])
        self.digits, self.digit_at = self._table([f"{i} " for i in range(size)])
        self.classes = self._classes()

    @staticmethod
    def _table(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        blobs = [s.encode() for s in strings]
        at = np.zeros(len(blobs) + 1, np.int64)
        np.cumsum([len(b) for b in blobs], out=at[1:])
        return np.frombuffer(b"".join(blobs), np.uint8), at

    @staticmethod
    def _spine(side: np.ndarray, rank: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        columns, until = [np.arange(size, dtype=np.int32)], [np.full(size, np.iinfo(np.int32).max, np.int32)]
        while (columns[-1] != NONE).any():
            top = columns[-1]
            has = top != NONE
            down, when = np.full(size, NONE, np.int32), np.full(size, -1, np.int32)
            down[has], when[has] = side[top[has]], rank[top[has]]
            columns.append(down)
            until.append(when)
        return np.stack(columns[:-1], 1), np.stack(until[:-1], 1)

    def compatible(self, a: np.ndarray, b: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Whether a stays apart from b. own: ranks of the merges of a with b themselves, which then don't count.

        A border merge of x (on a's right spine) with y (on b's left spine)
        happens if it comes before x and y are swallowed; of equal ranks the
        leftmost goes first, so x must be alive strictly longer.
        """
        good = np.ones(len(a), bool)
        for i in range(self.right_spine.shape[1]):
            x = self.right_spine[a, i]
            rows = np.flatnonzero((x != NONE) & good)
            if not len(rows):
                break
            for j in range(self.left_spine.shape[1]):
                y = self.left_spine[b[rows], j]
                rows, y = rows[y != NONE], y[y != NONE]
                if not len(rows):
                    break
                if own is not None and i == j == 0:
                    continue
                r = self.rank_of_pair.get(x[rows].astype(np.int64) << 20 | y)
                bound_x, bound_y = self.right_until[a[rows], i], self.left_until[b[rows], j]
                if own is not None:
                    bound_x, bound_y = np.minimum(bound_x, own[rows]), np.minimum(bound_y, own[rows])
                bad = (r != NONE) & (r < bound_x) & (r <= bound_y)
                good[rows[bad]] = False
                rows = rows[~bad]
        return good

    def _automaton(self, spelled: dict[int, list[int]], size: int) -> None:
        """Aho-Corasick over the tokens: goto and failure links; for each state the longest token it ends with, for each token the next shorter one."""
        nodes: dict[int, int] = {}
        token_at, parent, symbol, depth = [NONE], [0], [0], [0]
        for t, s in spelled.items():
            node = 0
            for c in s:
                key = node << 10 | c
                if key not in nodes:
                    nodes[key] = len(token_at)
                    token_at.append(NONE)
                    parent.append(node)
                    symbol.append(c)
                    depth.append(depth[node] + 1)
                node = nodes[key]
            token_at[node] = t
        self.goto = HashTable(np.fromiter(nodes, np.int64, len(nodes)), np.fromiter(nodes.values(), np.int32, len(nodes)))
        parent, symbol, depth = np.array(parent), np.array(symbol), np.array(depth)
        self.fail = np.zeros(len(token_at), np.int32)
        self.match = np.array(token_at, np.int32)
        self.shorter = np.full(size, NONE, np.int32)
        self.length = np.ones(size, np.int32)
        self.longest_token = int(depth.max())
        for d in range(1, self.longest_token + 1):  # links lead to lower levels, which are done
            level = np.flatnonzero(depth == d)
            if d > 1:
                self.fail[level] = self.step(self.fail[parent[level]], symbol[level])
            ends = self.match[self.fail[level]]
            own = self.match[level]
            whole = own != NONE
            self.shorter[own[whole]], self.length[own[whole]] = ends[whole], d
            self.match[level] = np.where(whole, own, ends)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states after `symbol`, along failure links where there is no goto."""
        to = self.goto.get(state.astype(np.int64) << 10 | symbol)
        left = np.flatnonzero(to == NONE)
        back = state[left]
        while len(left):
            top = back == 0
            to[left[top]] = 0
            left, back = left[~top], self.fail[back[~top]]
            hit = self.goto.get(back.astype(np.int64) << 10 | symbol[left])
            on = hit != NONE
            to[left[on]] = hit[on]
            left, back = left[~on], back[~on]
        return to

    def matches(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each place of the words symbols[start:end] the longest token that ends there and starts within the word.

        A state tells at most the longest token's length of what came before, so long words are
        walked in segments at once, each begun so many places ahead.
        """
        out = np.full(len(symbols), NONE, np.int32)
        parts = -(-(end - start) // SEGMENT)
        word = np.repeat(np.arange(len(start)), parts)
        number = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
        first = start[word] + number * SEGMENT
        at, stop = np.maximum(first - self.longest_token, start[word]), np.minimum(first + SEGMENT, end[word])
        order = np.argsort(at - stop, kind="stable")  # longest first: who is still under way stands in front
        at, stop, first = at[order], stop[order], first[order]
        size = stop - at
        state = np.zeros(len(at), np.int32)
        for k in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -k))
            place = at[:n] + k
            state = self.step(state[:n], symbols[place])
            own = place >= first[:n]
            out[place[own]] = self.match[state[own]]
        return out

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible(), through a direct-mapped table of the answers so far."""
        key = a.astype(np.int64) << 20 | b
        if not hasattr(self, "_known"):
            self._known, self._answer = np.full(1 << 19, -1, np.int64), np.zeros(1 << 19, bool)
        slot = (mix(key.astype(np.uint64)) & np.uint64((1 << 19) - 1)).astype(np.int64)
        out = self._answer[slot]
        new = np.flatnonzero(self._known[slot] != key)
        if len(new):
            out[new] = self.compatible(a[new], b[new])
            self._known[slot[new]] = key[new]
            # Two new keys may want one slot: the answer must be that of the key which got it.
            same = self._known[slot[new]] == key[new]
            self._answer[slot[new[same]]] = out[new[same]]
        return out

    def encode_words(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words symbols[start:end], one after the other, and how many each word has."""
        match = self.matches(symbols, start, end)
        n = len(start)
        offset = np.zeros(n + 1, np.int64)
        np.cumsum(end - start, out=offset[1:])
        stack, depth = np.full(offset[-1], NONE, np.int32), np.zeros(n, np.int64)  # a word's tokens fill its part from behind
        dead = np.zeros(len(symbols) + 1, bool)  # borders before which no encoding fits
        for i in np.flatnonzero(end - start > LOCKSTEP).tolist():
            ids = self.encode_long_word(match[start[i] : end[i]].tolist())
            depth[i] = len(ids)
            stack[offset[i + 1] - len(ids) : offset[i + 1]] = ids
        rows = np.flatnonzero(end - start <= LOCKSTEP)
        at = end.copy()
        candidate = match[end[rows] - 1]
        while len(rows):
            c = candidate
            after = np.where(depth[rows] > 0, stack[np.minimum(offset[rows + 1] - depth[rows], offset[-1] - 1)], NONE)
            good = c != NONE
            before = at[rows] - np.where(good, self.length[c], 0)
            good &= ~dead[before] | (before == start[rows])
            ask = np.flatnonzero(good & (after != NONE))
            good[ask] = self.pairs(c[ask], after[ask])
            take, drop = rows[good], c == NONE
            depth[take] += 1
            stack[offset[take + 1] - depth[take]] = c[good]
            at[take] = before[good]
            following = np.where(good, NONE, self.shorter[c])
            back = rows[drop]
            if len(back):
                if (depth[back] == 0).any():
                    raise ValueError("a word has no encoding in this vocabulary")
                dead[at[back]] = True
                last = stack[offset[back + 1] - depth[back]]
                depth[back] -= 1
                at[back] += self.length[last]
                following[drop] = self.shorter[last]
            done = good & (at[rows] == start[rows])
            go = good & ~done
            following[go] = match[at[rows[go]] - 1]
            rows, candidate = rows[~done], following[~done]
        keep = np.repeat(offset[1:], end - start) - np.arange(offset[-1]) <= np.repeat(depth, end - start)
        return stack[keep], depth

    def encode_long_word(self, match: list[int]) -> list[int]:
        """The same steps for one word, in a loop. match: the longest token that ends at each place."""
        if not hasattr(self, "_lists"):
            self._lists = self.shorter.tolist(), self.length.tolist(), dict(zip(*(x.tolist() for x in self.merges), strict=True))
            self._apart = lru_cache(1 << 17)(self.compatible_one)
        shorter, length, _ = self._lists
        dead, out, at, c = bytearray(len(match) + 1), [], len(match), match[-1]
        while at:
            while c != NONE and (dead[at - length[c]] or out and not self._apart(c, out[-1])):
                c = shorter[c]
            if c != NONE:
                out.append(c)
                at -= length[c]
                c = match[at - 1]
            elif out:
                dead[at] = 1
                c = out.pop()
                at += length[c]
                c = shorter[c]
            else:
                raise ValueError("a word has no encoding in this vocabulary")
        return out[::-1]

    def compatible_one(self, a: int, b: int) -> bool:
        """compatible() of one pair."""
        ranks = self._lists[2]
        left = [(y, u) for y, u in zip(self.left_spine[b].tolist(), self.left_until[b].tolist(), strict=True) if y != NONE]
        for x, until in zip(self.right_spine[a].tolist(), self.right_until[a].tolist(), strict=True):
            if x == NONE:
                break
            for y, u in left:
                r = ranks.get(x << 20 | y)
                if r is not None and r < until and r <= u:
                    return False
        return True

    # ---- from texts to words ---------------------------------------------------------------

    @staticmethod
    @lru_cache(maxsize=1)
    def _classes() -> np.ndarray:
        out = np.full(MARK + 64, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, MARK)]))
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
            out[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
        out[MARK:] = SPECIAL
        return out

    def encode(self, texts: list[str], cut_long: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, one after the other, and the offsets of each."""
        if cut_long and any(len(t) > LONG for t in texts):
            return self._encode_long(texts)
        parts, marks, lengths, total = [], [], [], 0
        cut = regex.compile("|".join(regex.escape(t) for t, _ in self.special)) if self.special else None
        number = {t: k for k, (t, _) in enumerate(self.special)}
        for text in texts:
            begin = total
            pieces = [text]
            if cut is not None and any(t in text for t in number):
                pieces, last = [], 0
                for m in cut.finditer(text):
                    pieces += [text[last : m.start()], m]
                    last = m.end()
                pieces.append(text[last:])
            for p in pieces:
                if isinstance(p, str):
                    p = unicodedata.normalize("NFC", p).replace("Σ", "σ").lower()
                    parts.append(p)
                    total += len(p)
                else:
                    marks.append((total, number[p.group()]))
                    parts.append("\0")
                    total += 1
            parts.append("\n")
            total += 1
            lengths.append(total - begin)
        joined = "".join(parts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        for at, k in marks:
            points[at] = MARK + k
        kind = self.classes[points]
        ends = np.cumsum(np.array(lengths, np.int64))
        first = np.ones(len(points), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER) | (kind[1:] == SPECIAL)
        self._contractions(points, kind, first)
        first &= kind != SPACE
        start = np.flatnonzero(first)
        border = np.flatnonzero(np.append(first | (kind == SPACE), True))
        end = border[np.searchsorted(border, start, side="right")] if len(start) else start
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + ((points >= 0x10000) & (points < MARK))
        width[points >= MARK] = 1
        byte_at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=byte_at[1:])
        buf = np.frombuffer(joined.encode(), np.uint8)
        special = kind[start] == SPECIAL if len(start) else np.zeros(0, bool)
        s, e = byte_at[start], byte_at[end]
        index, inverse = distinct_spans(buf, s, e, np.where(special, points[start] if len(start) else 0, 0))
        plain = ~special[index]
        us, ue = s[index], e[index]
        size = (ue - us) * plain
        offset = np.zeros(len(index) + 1, np.int64)
        np.cumsum(size, out=offset[1:])
        symbols = ragged(buf, us, size).astype(np.int64)
        symbols[offset[1:][plain] - 1] += 256
        ids, count = self.encode_words(symbols, offset[:-1][plain], offset[1:][plain])
        counts = np.ones(len(index), np.int64)
        counts[plain] = count
        id_at = np.zeros(len(index) + 1, np.int64)
        np.cumsum(counts, out=id_at[1:])
        table = np.empty(id_at[-1], np.int32)
        spread = np.repeat(plain, counts)
        table[spread] = ids
        table[~spread] = [self.special[int(points[start[i]]) - MARK][1] for i in index[~plain]]
        out = ragged(table, id_at[:-1][inverse], counts[inverse])
        before = np.zeros(len(start) + 1, np.int64)
        np.cumsum(counts[inverse], out=before[1:])
        return out, np.concatenate([[0], before[np.searchsorted(start, ends)]])

    def _encode_long(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), with long texts cut at spaces, which no word crosses. A text without spaces stays whole."""
        ids, at, total, done = [], [0], 0, 0
        for text in texts:
            begin = 0
            while begin < len(text):
                end = text.rfind(" ", begin, begin + LONG) + 1 if len(text) - begin > LONG else len(text)
                if end <= begin:
                    end = text.find(" ", begin + LONG) + 1 or len(text)
                part = text[begin:end]
                ids.append(self.encode([part], cut_long=False)[0])
                begin = end
            total += sum(map(len, ids[done:]))
            done = len(ids)
            at.append(total)
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.array(at)

    @staticmethod
    def _contractions(points: np.ndarray, kind: np.ndarray, first: np.ndarray) -> None:
        """A lone apostrophe at the start of a word joins the letters of a contraction after it."""
        n = len(points)
        at = np.flatnonzero((points == ord("'")) & first)
        at = at[at + 1 < n]
        at = at[kind[at + 1] == LETTER]
        for shape in CONTRACTIONS:
            if not len(at):
                return
            fits = at + len(shape) <= n - 1
            for i, c in enumerate(shape):
                fits &= points[np.minimum(at + i, n - 1)] == ord(c)
            hit = at[fits]
            for i in range(1, len(shape)):
                first[hit + i] = False
            first[hit + len(shape)] = True  # spaces are taken out later
            at = at[~fits]

    # ---- from ids to bytes -----------------------------------------------------------------

    def spelled(self, ids: np.ndarray, digits: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the decoded tokens (or of the decimal ids), each with a space after it, and their ends."""
        table, at = (self.digits, self.digit_at) if digits else (self.strings, self.string_at)
        size = at[ids + 1] - at[ids]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        return ragged(table, at[ids], size), ends

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by spaces, as a file without a decoder asks for."""
        return self.spelled(np.array(ids, np.int64))[0].tobytes()[:-1].decode()


def distinct_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of one span for each distinct (bytes, kind), and for each span which of them it equals. Hashes find equal ones, bytes decide."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = span_hashes(buf, start, end) ^ (kind.astype(np.uint64) << np.uint64(32))
    _, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
    size, lead = end - start, index[inverse]
    other = np.flatnonzero(lead != np.arange(len(start)))
    lead = lead[other]
    wrong = (size[other] != size[lead]) | (kind[other] != kind[lead])
    same = np.flatnonzero(~wrong)
    differ = ragged(buf, start[other[same]], size[other[same]]) != ragged(buf, start[lead[same]], size[other[same]])
    if differ.any():
        wrong[same[np.repeat(np.arange(len(same)), size[other[same]])[differ]]] = True
    if wrong.any():  # a span whose hash is that of another one stands for itself
        alone = other[wrong]
        inverse[alone] = len(index) + np.arange(len(alone))
        index = np.concatenate([index, alone])
    return index, inverse


def ragged(table: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """table[start:start + size] of all rows, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(start - (ends - size), size)
    at += np.arange(total)
    return table[at]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def text_blocks(texts: list[str], most: int = LONG):
    """Consecutive slices of about `most` characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256, decoded_sha256.

    Null text counts as empty and has no tokens. Each row stands alone, so ties,
    repeats and very long texts need no care; other columns are ignored.
    """
    small_arrow_batches(docs.sparkSession)

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, shas, decoded = [], [], []
            for a, b in text_blocks(texts):
                ids, at = vocab.encode(texts[a:b])
                n += np.diff(at).tolist()
                for digits, out in ((True, shas), (False, decoded)):
                    spelled, ends = vocab.spelled(ids, digits)
                    blob = memoryview(spelled)
                    for lo, hi in zip(ends[at[:-1]], ends[at[1:]], strict=True):
                        out.append(hashlib.sha256(blob[lo : max(lo, hi - 1)]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """docs with an array column of token ids. Null text: an empty array. A clashing column is replaced."""
    small_arrow_batches(docs.sparkSession)
    rows = docs.drop(out_col)
    place = rows.columns.index(text_col)

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            arrays = []
            for a, b in text_blocks(texts):
                ids, at = vocab.encode(texts[a:b])
                arrays.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(arrays) if arrays else pa.array([], pa.list_(pa.int32()))], [*batch.schema.names, out_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))]))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

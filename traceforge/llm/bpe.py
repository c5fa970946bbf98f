"""BPE encoding and decoding with a contiguous rank array.

A word is held as its part boundaries and, beside them, the merge rank of every adjacent pair. The lowest
rank is found by a scan, its boundary deleted, and the one or two neighbouring ranks refreshed, until no
pair has a rank. Words are short, so a scan over a small contiguous list beats a heap. A word of over ``SHORT``
symbols would take time with the square of its length, so its boundaries are linked and its lowest rank comes
from a heap, leftmost first, which gives the same ids. Texts are normalised and cut into words as the tokenizer
file says: NFC, white space to one blank, lower case; then its split pattern, byte symbols and an end-of-word
suffix.

Cases: a null text is an empty one and gives no ids; special-token strings inside a text are their ids, as
in the library; texts and words of any length are encoded whole; repeated rows are each encoded; a null id is
carried like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceforge.llm.shared import worked

#: Symbols of a word that is scanned; longer ones take a heap.
SHORT = 300
#: Words that are remembered have this many characters at most.
MEMORABLE = 64
#: A worker forgets its remembered words when they reach this number.
REMEMBER = 200_000

#: The split pattern of the tokenizer file, and the same for texts of Latin letters alone, where
#: the standard library's faster matcher agrees with it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Code points (hexadecimal ranges) that are letters or numbers to ``regex`` but not yet to the tokenizer library,
#: and capitals (first, last, step, distance to the small letter) that the library knows and Python may not.
NEW_LETTERS = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a
11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128
1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff
2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"""
NEW_NUMBERS = "11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6"
NEW_CAPITALS = [(0x1C89, 0x1C89, 1, 1), (0xA7CB, 0xA7CB, 1, 0x264 - 0xA7CB), (0xA7CC, 0xA7CE, 2, 1), (0xA7D2, 0xA7D4, 2, 1), (0xA7DA, 0xA7DA, 1, 1), (0xA7DC, 0xA7DC, 1, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 1, 0x20), (0x16EA0, 0x16EB8, 1, 0x1B)]
LATIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ſ]*")
LATIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-ZÀ-ÖØ-öø-ſ]+|[0-9]|[^\sa-zA-ZÀ-ÖØ-öø-ſ0-9]+")


def ranges(hexadecimal: str) -> str:
    """Ranges as the inside of a character class."""
    return "".join("-".join(f"\\U{x:0>8}" for x in r.split("-")) for r in hexadecimal.split())


NEWER = regex.compile(f"[{ranges(NEW_LETTERS)}{ranges(NEW_NUMBERS)}{ranges(' '.join(f'{a:x}-{b:x}' for a, b, _, _ in NEW_CAPITALS))}]")
SMALL = {c: c + d for a, b, step, d in NEW_CAPITALS for c in range(a, b + 1, step)}
LETTER, NUMBER = rf"[\p{{L}}--[{ranges(NEW_LETTERS)}]]", rf"[\p{{N}}--[{ranges(NEW_NUMBERS)}]]"
NEWER_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{LETTER}+|{NUMBER}|[^\s{LETTER}{NUMBER}]+", regex.V1)


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte: itself where printable, else the next code point from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class RankArrayBPE:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = self.vocab
        self.ranks = {ids[a] << 20 | ids[b]: i for i, (a, b) in enumerate(merges)}
        self.made = [ids[a + b] for a, b in merges]  # the id that a merge of each rank gives
        self.none = len(merges)
        self.specials = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.specials.items()}
        split = next(p for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"])
        if split["pattern"]["Regex"] != SPLIT:
            raise ValueError("the tokenizer file splits words by another pattern")
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        symbols = byte_symbols()
        self.byte_ids = [ids[s] for s in symbols]
        self.last_ids = [ids[s + self.suffix] for s in symbols]
        self.known: dict[str, list[int]] = {}

    def merge(self, parts: list[int]) -> list[int]:
        """Ids of symbols, merged in place until no adjacent pair has a rank."""
        get, none, made = self.ranks.get, self.none, self.made
        near = [get(a << 20 | b, none) for a, b in zip(parts, parts[1:])]
        while near:
            low = min(near)
            if low == none:
                break
            k = near.index(low)
            parts[k] = part = made[low]
            del parts[k + 1], near[k]  # the boundary between them goes
            if k:
                near[k - 1] = get(parts[k - 1] << 20 | part, none)
            if k < len(near):
                near[k] = get(part << 20 | parts[k + 1], none)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same for a long word: each part knows its neighbours, a heap the ranks of the pairs."""
        get, none, made = self.ranks.get, self.none, self.made
        size = len(parts)
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        heap = [(r, k) for k, r in enumerate(get(a << 20 | b, none) for a, b in zip(parts, parts[1:])) if r < none]
        heapq.heapify(heap)
        while heap:
            low, k = heapq.heappop(heap)
            nxt = after[k] if parts[k] >= 0 else size
            if nxt >= size or get(parts[k] << 20 | parts[nxt], none) != low:
                continue  # one of the two was merged meanwhile
            parts[k], parts[nxt] = made[low], -1
            after[k] = nxt = after[nxt]
            if nxt < size:
                before[nxt] = k
                if (r := get(parts[k] << 20 | parts[nxt], none)) < none:
                    heapq.heappush(heap, (r, k))
            prev = before[k]
            if prev >= 0 and (r := get(parts[prev] << 20 | parts[k], none)) < none:
                heapq.heappush(heap, (r, prev))
        return [p for p in parts if p >= 0]

    def word_ids(self, word: str) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            data = word.encode("utf-8")
            ids = [*map(self.byte_ids.__getitem__, data[:-1]), self.last_ids[data[-1]]]
            ids = self.merge(ids) if len(ids) <= SHORT else self.merge_long(ids)
            if len(word) <= MEMORABLE:
                if len(self.known) >= REMEMBER:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def plain_ids(self, text: str) -> list[int]:
        # white space only separates words, so it needs no rewriting first
        if LATIN.fullmatch(text):
            words = LATIN_WORD.findall(text.lower())
        else:
            text = unicodedata.normalize("NFC", text)
            # each code point is lowered by itself: no rule that looks at its neighbours
            newer = NEWER.search(text) is not None
            text = text.translate(SMALL) if newer else text
            text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
            words = (NEWER_WORD if newer or NEWER.search(text) else self.word).findall(text)
        known, out = self.known, []
        for word in words:
            ids = known.get(word)
            out += self.word_ids(word) if ids is None else ids
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out, at = [], 0
        for m in self.special.finditer(text) if self.special and "<" in text else ():
            out += self.plain_ids(text[at : m.start()])
            out.append(self.specials[m.group()])
            at = m.end()
        return out + self.plain_ids(text[at:] if at else text)

    def decode(self, ids: list[int]) -> str:
        """The token strings with blanks between, as the file names no decoder of its own."""
        return " ".join(map(self.strings.__getitem__, ids))


def tokenizer_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoded(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256[, ids])`` for every row of ``df``.

    The tokenizer file (about 2 MB) is read once by the driver and broadcast; each worker builds its tables
    once a task. Words repeat, so a worker remembers what it has merged, up to a fixed number of words.
    """
    spec = df.sparkSession.sparkContext.broadcast(tokenizer_spec(tokenizer_path))

    def setup() -> Callable:
        bpe = RankArrayBPE(spec.value)
        names = list(map(str, range(max(bpe.strings) + 1)))

        def work(texts: list) -> tuple[list, ...]:
            count, shown, decoded, all_ids = [], [], [], []
            for t in texts:
                ids = bpe.encode(t)
                count.append(len(ids))
                shown.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            return (count, shown, decoded, all_ids) if with_ids else (count, shown, decoded)

        return work

    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if with_ids else {})
    found = worked(df.select(F.col(key).alias("key"), F.col(text).alias("text")), ["text"], added, setup)
    return found.toDF(key, *added)

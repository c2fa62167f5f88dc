"""Fast, exact splitting of texts into the pre-tokens of a vocabulary file.

Characters below U+0250 are split here with one pattern per tokenizer; there NFC changes
nothing and classes and lower-casing agree with the library (the tests go through every one of
these characters).  A text with others is cut before white space that follows anything else,
where every pattern ends a pre-token and NFC and lower-casing look no further; only those of the
stretches between that hold such a character are left to the library, each as a whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

#: First character that is left to the library.
LIMIT = 0x250
#: White space below LIMIT as the library's patterns see it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0"
#: Entries that a worker's cache may hold before it starts anew.
CACHE = 500_000
#: Longest string, in characters, that the cache keeps.
CACHED = 200

other = re.compile(f"[^\\x00-{chr(LIMIT - 1)}]").search


def beyond(text: str) -> bool:
    """Is this stretch the library's: does it, or its lower-case form, hold a character from LIMIT on?"""
    return bool(other(text) or other(text.lower()))


# White space from LIMIT on in any version of Unicode, and invisible characters that have been or might be such: no cut beside them.
_DOUBTFUL = "\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff"
_LOW = re.escape(SPACE)
#: Stretches of a text, each but the first from white space below LIMIT on.
stretches = re.compile(f"[{_LOW}{_DOUBTFUL}]*[^{_LOW}{_DOUBTFUL}]+(?:[{_DOUBTFUL}][{_LOW}{_DOUBTFUL}]*[^{_LOW}{_DOUBTFUL}]*)*|[{_LOW}{_DOUBTFUL}]+").findall


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(LIMIT) if unicodedata.category(chr(c))[0] == kind)


@lru_cache(None)
def patterns() -> dict[str, re.Pattern]:
    """The splitting pattern of each kind of vocabulary with its classes spelt out."""
    letters, numbers, space = _class("L"), _class("N"), re.escape(SPACE)
    ends = "'s|'t|'re|'ve|'m|'ll|'d"
    return {
        # letters first: no other alternative can start where they do
        "byte": re.compile(f" ?[{letters}]+|{ends}| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"),
        "word": re.compile(f"[{letters}]+|{ends}|[{numbers}]|[^{space}{letters}{numbers}]+"),
    }


#: The normaliser and pre-tokenizer sections that the patterns above are proven equal to.
PROVEN = {
    "byte": (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    "word": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    ),
}


@lru_cache(8)
def kind_of(path: str) -> str | None:
    """Which of ``patterns`` splits texts as this vocabulary file says; None if that is not proven, so the library must encode whole texts."""
    if not path.endswith(".json"):
        return None
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model = said["model"]
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    literal = all(t["content"].startswith("<") and not any(t.get(k) for k in ("normalized", "lstrip", "rstrip", "single_word")) for t in said["added_tokens"])
    if not (plain and literal) or said.get("post_processor"):
        return None
    return next((kind for kind, own in PROVEN.items() if own == (said.get("normalizer"), said.get("pre_tokenizer"))), None)


def splitter(path: str) -> Callable[[str], list[str]] | None:
    """A text without added tokens to its pre-tokens and, where ``beyond``, stretches as they stand; no function for unproven files."""
    kind = kind_of(path)
    if kind is None:
        return None
    find = patterns()[kind].findall

    def split(text: str) -> list[str]:
        shown = text.lower() if kind == "word" else text
        if text.isascii() or not (other(text) or other(shown)):
            return find(shown)
        out = []
        for s in stretches(text):
            if not s.isascii() and beyond(s):
                out.append(s)
            else:
                out += find(s.lower() if kind == "word" else s)
        return out

    return split


def whole_ids(path: str) -> Callable[[list[str]], list[list[int]]]:
    """The library's ids of whole texts, nothing added: tokenizers for .json files, sentencepiece for .model files."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1)
    lib = library(path)
    lib.no_truncation()
    lib.no_padding()
    return lambda texts: [e.ids for e in lib.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(4)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(4)
def specials(path: str) -> re.Pattern | None:
    """Added tokens, which the library finds in a text before anything else."""
    added = [t.content for t in library(path).get_added_tokens_decoder().values()]
    return re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None


@lru_cache(None)
def _byte_characters() -> list[str]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, from U+0100."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in kept else next(rest)) for b in range(256)]


def vocabulary_strings(path: str) -> list[str]:
    """The texts that the entries of a proven vocabulary stand for, without marks of word ends."""
    lib = library(path)
    byte = {c: b for b, c in enumerate(_byte_characters())}
    end = lib.model.end_of_word_suffix or ""
    out = {}
    for token in lib.get_vocab(with_added_tokens=False):
        raw = bytes(byte[c] for c in token.removesuffix(end) if c in byte)
        text = raw.decode("utf-8", "ignore")
        if text:
            out[text] = None
    return list(out)


@lru_cache(4)
def merger(path: str) -> Callable[[str], list[int]]:
    """Ids of what ``splitter`` gives: a pre-token through the library's merges alone, a stretch ``beyond`` through all of it."""
    table, merge, whole = dict(enumerate(_byte_characters())), library(path).model.tokenize, whole_ids(path)

    def ids(word: str) -> list[int]:
        if beyond(word):
            return whole([word])[0]
        return [t.id for t in merge(word.encode().decode("latin-1").translate(table))]

    return ids

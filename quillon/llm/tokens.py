"""Token ids of whole texts, segment by segment, with the tokenizers library.

A byte-level or word-level BPE never merges across its pre-tokens, and white
space between two other characters always ends one. A text can so be cut at its
lone blanks and line ends, each distinct segment encoded once and remembered,
and the ids of the text put together from those of its segments. Texts for
which that doesn't hold (white space in a row, unusual pre-tokenizers) go to
the library whole or in longer segments; the ids are the library's either way.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable

from quillon.llm.shared import turn_to

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The pre-token patterns of byte-level vocabularies and of the word vocabulary.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Segments of other characters than these are encoded by the library as a whole. In
#: this range Python's letters and digits are those of the patterns (superscripts and fractions left out).
PLAIN = r"!-~\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ"
BYTE_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s")
WORD_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
ENDS = frozenset(".,;:!?")
#: White space other than blanks and line ends.
ODD = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
PAIRS = ("  ", " \n", "\n ", "\n\n")
DOUBLE = re.compile(r"\s\s|\A\s")
#: Marks a segment at the start of a text with white space in a row; no other starts so.
START = "\n\n"
#: Before a lone blank or line end between two other characters.
LONE = re.compile(r"(?<=\S)(?=[ \n]\S)")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}


class Segments(dict):
    """Segment -> its ids as little-endian unsigned 32-bit bytes, computed when first asked for."""

    #: Entries of the newer and of the older half; when the newer is full, the older goes. Longer segments are not kept.
    MOST, LONGEST = 250_000, 64

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, key: str) -> bytes:
        if (ids := self.older.get(key)) is None:
            ids = self.encode(key)
        if len(key) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.older = dict(self)
                self.clear()
            self[key] = ids
        return ids


class Encoder:
    """Ids of texts by a tokenizers ``.json`` file, without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_str(json.dumps(spec))
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.tokenize = self.model.tokenize
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.letters = _byte_letters()
        self.mode = self._mode(spec)
        self.ranked = self._ranked(spec) if self.mode == "byte" else None
        first = "".join(re.escape(c) for c in sorted({s[0] for s in self.special}))
        self.plain = re.compile(f"(?:(?![{first}])[{PLAIN}])*\\Z" if first else f"[{PLAIN}]*\\Z").match
        self.pieces = Segments(self._piece)
        self.segments = Segments({"word": self._word, "byte": self._byte, "whole": self._library_ids}[self.mode])
        #: Ids of the line end that split() puts before a text.
        self.extra = int(self.mode == "byte")

    def _mode(self, spec: dict) -> str:
        """``byte``: a blank leads the next pre-token; ``word``: white space is dropped; ``whole``: neither is known to hold."""
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or any(
            t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") or re.search(r"\s", t["content"])
            for t in spec.get("added_tokens") or []
        ):
            return "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            return "byte"
        steps = pre.get("pretokenizers") or []
        norms = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers") or []]
        if (
            [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"] == {"Regex": WORD_PATTERN}
            and (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True)
            and not (steps[1]["use_regex"] or steps[1]["add_prefix_space"])
            and norms == ["NFC", "Replace", "Lowercase"]
        ):
            return "word"
        return "whole"

    def _ranked(self, spec: dict):
        """The same merges as a table of ranks, which is faster for short segments; none where the ids don't follow the merges' order."""
        import tiktoken

        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        special = {t["content"] for t in spec.get("added_tokens") or []}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        if spec["model"].get("end_of_word_suffix"):
            return None
        if any(ids.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)) or len(set(ids) - special) != 256 + len(pairs):
            return None
        back = {c: b for b, c in self.letters.items()}
        if any(ids.get(c, 256) > 255 for c in back):
            return None
        ranks = {bytes(back[c] for c in t): i for t, i in ids.items() if t not in special}
        return tiktoken.Encoding("ranked", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def _library_ids(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Of one pre-token."""
        symbols = piece.replace(" ", "Ġ") if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(symbols)]).tobytes()

    def _byte(self, key: str) -> bytes:
        """A segment that starts with a line end stands for itself, another for itself after a blank."""
        if self.plain(key) is not None:
            text = " " + key
        elif key[:1] != "\n":
            return self._library_ids(" " + key)
        elif key.startswith(START):
            return self._library_ids(key[2:])
        elif self.plain(key[1:]) is not None:
            text = key
        else:
            return self._library_ids(key)
        if self.ranked is not None:
            return array("I", self.ranked(text)).tobytes()
        return b"".join(map(self.pieces.__getitem__, BYTE_PLAIN.findall(text)))

    def _word(self, key: str) -> bytes:
        if self.plain(key) is None:
            return self._library_ids(key)
        if key.isalpha():
            return self._piece(key) if key.islower() else self.segments[key.lower()] if key.isascii() else self._piece(key.lower())
        if key[-1:] in ENDS and key[:-1].isalpha():
            return self.segments[key[:-1]] + self.pieces[key[-1]]
        return b"".join([self.segments[p] if p.isalpha() and p.islower() else self.pieces[p] for p in WORD_PLAIN.findall(key.lower())])

    def split(self, text: str) -> list[str]:
        """Segments whose ids, one after the other, are those of the text; in byte mode after those of one line end."""
        if self.mode == "word":
            return [text] if any(c in text for c in ODD[4:]) else text.split()
        if self.mode == "byte":
            odd = text[:1].isspace() or any(c in text for c in ODD) or any(c in text for c in PAIRS)
            if not (odd and DOUBLE.search(text)):
                return ("\n" + text).replace("\n", " \n").split(" ")[1:]
            return ["\n", *self._wide(text)]
        return [text]

    def _wide(self, text: str) -> list[str]:
        """Segments of a text with white space in a row: cut only where a lone blank or line end stands."""
        first, *rest = LONE.split(text)
        return [START + first, *(s[1:] if s[0] == " " else s for s in rest)]

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text (null: none)."""
        if not text:
            return b""
        return b"".join(map(self.segments.__getitem__, self.split(text)))[4 * self.extra :]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    turn_to("tokens", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def all_ids(path: str, texts: Iterable[str | None]) -> Iterable[bytes]:
    e = encoder(path)
    return map(e.ids, texts)

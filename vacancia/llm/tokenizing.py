"""Ids of texts by public tokenizer files, with a memo of the chunks that texts share.

Byte-pair tokenizers never merge across the pieces their pattern cuts, and neither of the two known kinds
cuts a piece that holds a blank after other characters. So a text's ids are those of its chunks (a chunk is
a run of blanks and the characters after it), and a chunk is encoded once per task. Chunks are taken apart
here only over an alphabet on which all Unicode tables agree; any other text goes to the library whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import regex

MEMO_SIZE = 250_000  # entries of a memo's generation; it saves time, never changes a result

_CHUNK = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
# Bytes of Latin-1 texts that are taken apart; "<|" may begin a special token.
_KNOWN = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA1, 0x100)])
# Fixed value: the pattern that byte-level tokenizers use unless their file names another.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def version(path: str) -> bytes:
    """Digest of a tokenizer file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).digest()


def vocabulary_size(path: str) -> int:
    """One above the largest id of a tokenizer file."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1


def byte_letters() -> list[str]:
    """The letter a byte-level vocabulary writes for each byte: itself if printable, else one from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def taken_whole(text: str) -> bool:
    """Whether a text has characters on which Unicode tables may differ, or what may begin a special token."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return b"<|" in data or bool(data.translate(None, _KNOWN))


class Memo(dict):
    """Results of `make` by key. A full generation becomes the old one, from which what is asked again returns."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        found = self[key] = self.make(key) if found is None else found
        if len(self) >= MEMO_SIZE:
            self.old = dict(self)
            self.clear()
        return found


class Encoder:
    """`ids(text)`: the library's ids, without added ones, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.chunks, self.pieces = Memo(self.of_chunk), Memo(self.of_piece)
        self.pattern = self.model = None
        if path.endswith(".model"):
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda text: array("I", piece.encode(text)).tobytes()
            return
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.whole = lambda text: array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        with open(path, encoding="utf-8") as f:
            self.known(json.load(f))

    def known(self, file: dict) -> None:
        """Set up chunks if the file is one of the two kinds; otherwise every text is encoded whole."""
        pre, norm = file.get("pre_tokenizer") or {}, file.get("normalizer") or {}
        if not all(x["content"].startswith("<|") for x in file["added_tokens"]) or file["model"]["type"] != "BPE":
            return
        if not norm and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            self.lower, self.taken_apart, pattern = False, _CHUNK.findall, BYTE_PATTERN
        elif [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and norm["normalizers"][1]["content"] == " ":
            split, level = pre["pretokenizers"]
            if split["behavior"] != "Removed" or not split["invert"] or level["use_regex"] or level["add_prefix_space"] or r"[^\s" not in split["pattern"]["Regex"]:
                return
            self.lower, self.taken_apart, pattern = True, str.split, split["pattern"]["Regex"]
        else:
            return
        self.pattern, self.model = regex.compile(pattern), self.library.model
        self.letters = dict(enumerate(byte_letters()))

    def ids(self, text: str) -> bytes:
        if self.model is None or taken_whole(text):
            return self.whole(text)
        return b"".join(map(self.chunks.__getitem__, self.taken_apart(text.lower() if self.lower else text)))

    def of_chunk(self, chunk: str) -> bytes:
        if self.lower:
            chunk = chunk.lower()
        if chunk.isalpha() or chunk[0] == " " and chunk[1:].isalpha():
            return self.of_piece(chunk)  # letters, at most one blank before them: a single piece
        if chunk[-1] in ".,;:!?)" and (chunk[:-1].isalpha() or chunk[0] == " " and chunk[1:-1].isalpha()):
            return self.chunks[chunk[:-1]] + self.pieces[chunk[-1]]  # the same and a mark, which is a piece
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(chunk)))

    def of_piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isalpha()):  # those letters write themselves
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(path)

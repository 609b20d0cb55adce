"""Byte-level BPE: encoding and decoding with the ``tokenizers`` library over Arrow batches.

The rank file lists byte strings. Each byte is mapped to a printable character, as byte-level
vocabularies do, and the ranks become merges: every split of a token into two tokens is a merge,
in the order of the ranks, which is what merging the pair of lowest rank means. A text is first
split into runs of text and of white space at which no match of the pattern can cross, so that a
run's ids, once computed, serve for all its later occurrences.

Null and empty texts have no ids. Repeated rows are encoded each on its own.
"""

from __future__ import annotations

import base64
import codecs
import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sliceworks.llm.common import add_columns, int_lists, worker_state

#: White space as the pattern's engine defines it (Unicode White_Space), fixed values.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Runs that no match of the splitting pattern crosses.
RUN = f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: ASCII signs but the apostrophe, with which contractions begin; the pattern takes them together.
SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: Longest run that is kept, and runs that a worker keeps of each of two ages, unless told otherwise.
KEPT_LENGTH, KEPT_RUNS = 64, 150_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte."""

    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in set(shown))
    table = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file by id."""

    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[k] for k in range(len(ranks))]


def tokenizer_json(tokens: Sequence[bytes], pattern: str) -> str:
    """A tokenizer of the ``tokenizers`` library that merges by these ranks."""

    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    characters, known = byte_characters(), set(tokens)
    text = ["".join(characters[b] for b in token) for token in tokens]
    spelt = dict(zip(tokens, text, strict=True))
    merges = [(spelt[t[:k]], spelt[t[k:]]) for t in tokens for k in range(1, len(t))
              if t[:k] in known and t[k:] in known]
    model = models.BPE(vocab={t: k for k, t in enumerate(text)}, merges=merges, ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer.to_str()


class RunEncoder(dict):
    """Ids of texts as little-endian unsigned 32-bit integers, by runs, which are its keys.

    ``find`` must cut a text so that the ids of the text are those of its runs in order. Runs of Latin
    letters (put in lower case, if ``lower``) and then signs are two pieces, which go to the merges
    without the tokenizer's other steps. Ids of short runs and of their two pieces are kept; when too
    many are, the ones not used since the last such time go. A task has one core, so the tokenizer
    starts no threads.
    """

    def __init__(self, tokenizer: str, find: Callable[[str], list[str]], lower: bool,
                 kept: int = KEPT_RUNS) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.kept = kept
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.find = Tokenizer.from_str(tokenizer), find
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.merge, self.lower = self.tokenizer.model.tokenize, lower
        self.characters = byte_characters()
        self.old: dict[str, bytes] = {}

    def piece_ids(self, piece: str) -> bytes:
        """Ids of one piece, kept from then on."""

        ids = self.get(piece) or self.old.get(piece)
        if ids is None:
            if piece.isascii() and piece[0] != " ":
                shown = piece
            else:
                shown = "".join(map(self.characters.__getitem__, piece.encode()))
            ids = array("I", [t.id for t in self.merge(shown)]).tobytes()
        self[piece] = ids
        return ids

    def __missing__(self, run: str) -> bytes:
        """Ids of a run that is not among the keys; kept if it is short."""

        if (ids := self.old.get(run)) is None:
            letters = run.rstrip(SIGNS)
            word = letters[1:] if letters[:1] == " " else letters
            if len(run) <= KEPT_LENGTH and word.isalpha() and (word.isascii() or max(word) <= "\xff"):
                ids = self.piece_ids(letters.lower() if self.lower else letters)
                if len(letters) < len(run):
                    ids += self.piece_ids(run[len(letters):])
            else:
                found = self.tokenizer.encode(run, add_special_tokens=False)
                ids = array("I", found.ids).tobytes()
        if len(run) <= KEPT_LENGTH:
            self[run] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self) > self.kept:
            self.old = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, self.find(text)))


def encoder_of(spark, tokenizer: str, finder: Callable[[], Callable[[str], list[str]]],
               lower: bool, kept: int = KEPT_RUNS) -> Callable[[], RunEncoder]:
    """What makes the encoder in a worker; the tokenizer, a fixed file, is sent once."""

    sent = spark.sparkContext.broadcast(tokenizer)
    key = f"encoder_{zlib.crc32(tokenizer.encode())}_{lower}_{kept}"
    return lambda: worker_state(key, lambda: RunEncoder(sent.value, finder(), lower, kept))


def run_finder() -> Callable[[str], list[str]]:
    """Finds the runs of a text; where all white space is ASCII, by a pattern that is faster."""

    every, ascii_only = (re.compile(RUN.replace(SPACE, space)).findall for space in (SPACE, "\t-\r "))
    other = [chr(c) for c in range(0x80, 0x3001) if re.match(f"[{SPACE}]", chr(c))]

    def runs(text: str) -> list[str]:
        if text.isascii() or not any(c in text for c in other):
            return ascii_only(text)
        return every(text)

    return runs


def encode_bytes(df: DataFrame, ranks_path: str, pattern: str, text: str = "text",
                 ids: str = "ids", ends: str = "ends") -> DataFrame:
    """Adds the ids of every text and where each token ends, in bytes of the UTF-8 text."""

    tokens = read_ranks(ranks_path)
    make = encoder_of(df.sparkSession, tokenizer_json(tokens, pattern), run_finder, False)
    lengths = np.array([len(t) for t in tokens], dtype=np.int32)

    def start():
        encoder = make()

        def encode(texts: list[str | None]):
            found = [np.frombuffer(encoder.encode(t), dtype="<u4").astype(np.int32) for t in texts]
            return int_lists(found), int_lists([np.cumsum(lengths[x]) for x in found])

        return encode

    return add_columns(df, [text], [(ids, "array<int>"), (ends, "array<int>")], None, start=start)


def decode_table(tokens: Sequence[str]) -> list[bytes]:
    """Bytes of each token of a byte-level vocabulary, by the byte table reversed."""

    back = {c: b for b, c in enumerate(byte_characters())}
    return [bytes(back[c] for c in token) for token in tokens]


def token_texts(pieces: Sequence[bytes]) -> list[str]:
    """Text that each token completes: a character split between tokens is given with the last."""

    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    return [decoder.decode(piece) for piece in pieces]


def decoder(spark, ranks_path: str) -> Callable[[], Callable[[pa.Array], tuple]]:
    """What makes, in a task, the function from lists of ids to their bytes and the number of tokens
    that end inside a character."""

    characters = byte_characters()
    spelt = ["".join(characters[b] for b in token) for token in read_ranks(ranks_path)]
    sent = spark.sparkContext.broadcast(json.dumps(spelt))
    key = f"decoder_{zlib.crc32(' '.join(spelt).encode())}"

    def make():
        table = decode_table(json.loads(sent.value))
        # a token ends inside a character if the byte that follows continues one
        return table, np.array([(t[0] & 0xC0) == 0x80 for t in table])

    def start():
        table, follows = worker_state(key, make)

        def decode(lists: pa.Array) -> tuple[pa.Array, list[int]]:
            out, cut = [], []
            for x in id_arrays(lists):
                out.append(b"".join(map(table.__getitem__, x.tolist())))
                cut.append(int(follows[x[1:]].sum()))
            return pa.array(out, pa.binary()), cut

        return decode

    return start


def decode_bytes(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded",
                 split: str = "n_split") -> DataFrame:
    """Adds the bytes that ids stand for and the number of tokens that end inside a character.

    The bytes are UTF-8 whenever the ids are those of a text; part of a text's ids may begin or
    end inside a character, which is why bytes are returned. Null ids give no bytes.
    """

    return add_columns(df, [ids], [(out, "binary"), (split, "bigint")], None, arrow=True,
                       start=decoder(df.sparkSession, ranks_path))


def id_arrays(lists: pa.Array) -> list[np.ndarray]:
    """The lists of a column as numpy arrays; a null list is empty."""

    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.split(lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)[:-1])

"""Token-level tools that run inside tasks: tokenizers and the unigram model."""

from __future__ import annotations

import json
import math
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries that one worker remembers before it starts afresh.
MEMO_ENTRIES = 600_000

SPACE = "▁"


def public_path(name: str) -> str:
    """Where the public tokenizers' files are; callers may pass other paths."""
    import public_tokenizers

    return public_tokenizers.path(name)


# --- byte-level BPE ---------------------------------------------------------


#: White space in a row from which a text goes to the plain library.
LONG_SPACE = 10_000


@lru_cache(maxsize=2)
def library(path: str):
    """The file's own tokenizer: text -> ids, special strings included."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _special(spec: dict, *others: str) -> re.Pattern:
    """Finds the texts that only the library itself can encode."""
    return re.compile("|".join([*(re.escape(t["content"]) for t in spec["added_tokens"]), *others]) or r"(?!)")


def _byte_ranks(path: str) -> tuple[dict, dict[bytes, int]]:
    """A plain byte-level BPE file and the id of each of its ordinary tokens' bytes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
        raise ValueError(f"not a plain byte-level BPE: {path}")
    back = {c: b for b, c in enumerate(byte_letters())}
    special = {t["content"] for t in spec["added_tokens"]}
    return spec, {bytes(back[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}


def _merges(ranks: dict[bytes, int]):
    import tiktoken

    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=2)
def byte_bpe(path: str):
    """Encoder of a byte-level BPE file of the ``tokenizers`` library.

    Returns text -> ids, those of that library's plain call without added
    special tokens: a special string in a text is its one id.  The merges run
    in tiktoken, whose ranks are that file's own ids: same result, less time.
    Texts with special strings or very long white space, which tiktoken's
    pattern can't take, go through the library.
    """
    spec, ranks = _byte_ranks(path)
    fast = _merges(ranks)
    plain = _special(spec, rf"\s{{{LONG_SPACE}}}").search

    def encode(text: str) -> list[int]:
        if plain(text):
            return library(path).encode(text, add_special_tokens=False).ids
        return fast(text)

    return encode


@lru_cache(maxsize=2)
def ordinary_byte_bpe(path: str):
    """(text -> ids in which special strings are ordinary text, bytes of each id) of such a file."""
    _, ranks = _byte_ranks(path)
    fast = _merges(ranks)
    long_space = re.compile(rf"\s{{{LONG_SPACE}}}").search
    texts = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        texts[i] = token

    def encode(text: str) -> list[int]:
        if len(text) < LONG_SPACE or not long_space(text):
            return fast(text)
        from tokenizers import Tokenizer  # seldom: not kept

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        return whole.encode(text, add_special_tokens=False).ids

    return encode, texts


@lru_cache(maxsize=2)
def piece_model(path: str):
    """(texts -> ids of each, bytes of each id, whether words after a space can be encoded apart) of a SentencePiece file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    texts = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
    apart = not any(SPACE in p.lstrip(SPACE) for p in pieces)
    return lambda words: model.encode(words, num_threads=1), texts, apart


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable letter that byte-level BPE files use for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


# --- word BPE ---------------------------------------------------------------


#: The pre-tokenizer whose words can be encoded apart: white space goes, letters stay together,
#: anything else but digits stays together.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Words of Latin letters, with or without one comma or full stop behind.
PLAIN_WORD = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"


def ragged(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start[i]:start[i] + length[i]] of all i in a row."""
    return flat[np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())]


class WordEncoder:
    """A ``tokenizers`` file that drops white space, over Arrow arrays of texts.

    Ids are those of the library's plain call without added special tokens.
    White space separates words for good, so a text's ids are those of its
    words in a row, and each distinct word of a batch is encoded once.  Words
    go to the library many at once, joined by spaces: the pieces that end a
    pre-token tell them apart.  Plain words lose case and tail before, so they
    need neither its normalizer nor its pattern.  Words beyond ASCII that are
    not plain go one by one, texts with special strings whole, and so does
    everything if the file is of another kind.  Nothing is kept between batches.
    """

    def __init__(self, path: str):
        self.tokenizer = library(path)
        spec = json.loads(self.tokenizer.to_str())
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        kinds = [n.get("type") for n in (spec["normalizer"] or {}).get("normalizers", [])]
        tail = spec["model"].get("end_of_word_suffix")
        self.known = bool(tail) and kinds == ["NFC", "Replace", "Lowercase"] and split.get("pattern", {}).get("Regex") == WORD_PATTERN
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if tail and t.endswith(tail)]] = True
        self.tails = [(c, int(self.ids(c)[0])) for c in ",." if self.known]
        self.bare = self.tokenizer
        if self.known:
            from tokenizers import Tokenizer, pre_tokenizers

            self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None}))
            self.bare.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, tokenizer, names: list[str], parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, ids of each) of words that have so many pre-tokens each."""
        texts = [" ".join(names[i : i + 1000]) for i in range(0, len(names), 1000)]
        flat = [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate([*flat, np.zeros(0, np.uint32)])
        last = np.flatnonzero(self.ends[flat]) + 1
        if len(last) != parts.sum():
            raise ValueError("a pre-token does not end in one end-of-word piece")
        upto = np.concatenate([[0], last])[np.cumsum(parts)].astype(np.int64) if len(names) else np.zeros(0, np.int64)
        return flat, np.diff(upto, prepend=0)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all distinct words in a row, ids of each)."""
        plain = pc.match_substring_regex(words, PLAIN_WORD)
        low = pc.utf8_lower(words.filter(plain))
        tails = [pc.ends_with(low, c).to_numpy(zero_copy_only=False) for c, _ in self.tails]
        stems = pc.utf8_rtrim(low, ",.").dictionary_encode()
        stem = stems.indices.to_numpy()
        stem_ids, stem_size = self._joined(self.bare, stems.dictionary.to_pylist(), np.ones(len(stems.dictionary), np.int64))
        rest = words.filter(pc.invert(plain))
        ascii_ = pc.match_substring_regex(rest, "^[!-~]+$")
        some = rest.filter(ascii_)
        parts = pc.count_substring_regex(pc.ascii_lower(some), WORD_PATTERN).to_numpy().astype(np.int64)
        some_ids, some_size = self._joined(self.tokenizer, some.to_pylist(), parts)
        others = self._batch(rest.filter(pc.invert(ascii_)).to_pylist())
        # where the two parts of each word lie: its own ids, and its tail
        flat = np.concatenate([stem_ids, np.array([i for _, i in self.tails], np.uint32), some_ids, *others])
        begin = lambda size, at: at + np.cumsum(size) - size
        plain, ascii_ = plain.to_numpy(zero_copy_only=False), ascii_.to_numpy(zero_copy_only=False)
        start, size = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        at = np.flatnonzero(plain)
        start[at, 0], size[at, 0] = begin(stem_size, 0)[stem], stem_size[stem]
        for k, has in enumerate(tails):
            start[at[has], 1], size[at[has], 1] = len(stem_ids) + k, 1
        behind = len(stem_ids) + len(self.tails)
        at = np.flatnonzero(~plain)
        start[at[ascii_], 0], size[at[ascii_], 0] = begin(some_size, behind), some_size
        sizes = np.array([len(o) for o in others], np.int64)
        start[at[~ascii_], 0], size[at[~ascii_], 0] = begin(sizes, behind + len(some_ids)), sizes
        return ragged(flat, start.ravel(), size.ravel()), size.sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each); null is empty."""
        texts = pc.fill_null(texts, "")
        if not self.known:
            got = self._batch(texts.to_pylist())
            return np.concatenate([*got, np.zeros(0, np.uint32)]), np.array([len(g) for g in got], np.int64)
        apart = np.zeros(len(texts), bool)
        for name in self.special:
            apart |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        lists = pc.ascii_split_whitespace(pc.if_else(pa.array(apart), "", texts))
        bounds = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        flat, size = self._words(words.dictionary)
        code = words.indices.to_numpy()
        ids = ragged(flat, (np.cumsum(size) - size)[code], size[code])
        upto = np.concatenate([[0], np.cumsum(size[code])])[bounds - bounds[0]]
        count = np.diff(upto)
        if apart.any():
            parts = np.split(ids, upto[1:-1])
            for i in np.flatnonzero(apart):
                parts[i] = self.ids(texts[int(i)].as_py())
            ids, count = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, count


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# --- unigram ----------------------------------------------------------------


class Unigram:
    """A unigram vocabulary: the ordinary pieces of a SentencePiece file.

    Files that hold merges have ranks in place of log-probabilities; a piece
    of rank r gets -log2(r + 2) then, rounded to 1/16 so that sums are exact
    in any order.  A unigram file's own scores are taken as they are.

    Tie rules are the tokenizer's: of equally good ways to a position, that
    whose last piece starts first; a character with no piece of its own is
    unknown, scores the least piece less 10, and becomes its UTF-8 bytes.
    """

    UNKNOWN = 10.0

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as model

        self.proto = model.ModelProto()
        with open(path, "rb") as f:
            self.proto.ParseFromString(f.read())
        ranked = self.proto.trainer_spec.model_type != model.TrainerSpec.UNIGRAM
        normal = [(i, p) for i, p in enumerate(self.proto.pieces) if p.type == model.ModelProto.SentencePiece.NORMAL]
        if ranked:
            first = max(p.score for _, p in normal)
            for _, p in normal:
                p.score = round(-16 * math.log2(first - p.score + 2)) / 16
            self.proto.trainer_spec.model_type = model.TrainerSpec.UNIGRAM
        self.pieces = {p.piece: (i, float(p.score)) for i, p in normal}
        self.unknown_score = min(s for _, s in self.pieces.values()) - self.UNKNOWN
        bytes_at = {p.piece: i for i, p in enumerate(self.proto.pieces) if p.type == model.ModelProto.SentencePiece.BYTE}
        self.byte_ids = [bytes_at[f"<0x{b:02X}>"] for b in range(256)]
        self.text_of = [b""] * len(self.proto.pieces)
        for i, p in normal:
            self.text_of[i] = p.piece.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.text_of[i] = bytes([b])
        # no piece goes from another character over to a space: words part there
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        newline = any("\n" in p for p in self.pieces)
        self.word = re.compile(r"(?s).+" if crossing or newline else f"\n+|{SPACE}*[^{SPACE}\n]+|{SPACE}+")

    def model_bytes(self) -> bytes:
        """A model file for the ``sentencepiece`` library, to compare with."""
        return self.proto.SerializeToString()

    def words(self, texts: list[str]) -> list[list[str]]:
        """Parts of each text that no best path can join."""
        prefix = SPACE if self.proto.normalizer_spec.add_dummy_prefix else ""
        return [self.word.findall(prefix + t.replace(" ", SPACE)) if t else [] for t in texts]


@lru_cache(maxsize=2)
def unigram(path: str) -> Unigram:
    return Unigram(path)


class Counter:
    """Count-only Viterbi over Aho-Corasick matches.

    The automaton reports every piece that ends at each character, longest
    first; a cell keeps the best score and how many pieces it took, nothing
    to trace back.
    """

    def __init__(self, path: str):
        import ahocorasick

        self.vocabulary = unigram(path)
        self.automaton = ahocorasick.Automaton()
        for piece, (_, score) in self.vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.memo: dict[str, tuple[int, float]] = {}

    def _count(self, word: str) -> tuple[int, float]:
        unknown = self.vocabulary.unknown_score
        n = len(word)
        best, count, single = [-math.inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        done = 0  # cells up to here also had their unknown step

        def step(upto: int) -> None:
            # a lone character without a piece: its start is the latest, so it comes last
            for e in range(done + 1, upto + 1):
                if not single[e] and best[e - 1] + unknown > best[e]:
                    best[e], count[e] = best[e - 1] + unknown, count[e - 1] + len(word[e - 1].encode())

        for end, (length, score) in self.automaton.iter(word):
            e = end + 1
            if e - 1 > done:
                step(e - 1)
                done = e - 1
            s = best[e - length] + score
            if s > best[e]:
                best[e], count[e] = s, count[e - length] + 1
            if length == 1:
                single[e] = True
        step(n)
        return count[n], best[n]

    def count(self, texts: list[str]) -> list[tuple[int, float]]:
        words = self.vocabulary.words(texts)
        new = set(chain.from_iterable(words)).difference(self.memo)
        if len(self.memo) + len(new) > MEMO_ENTRIES:
            self.memo, new = {}, set(chain.from_iterable(words))
        for w in new:
            self.memo[w] = self._count(w)
        get = self.memo.__getitem__
        out = []
        for ws in words:
            found = list(map(get, ws))
            out.append((sum(c for c, _ in found), math.fsum(s for _, s in found)))
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)

"""Token ids by the tokenizers library, with each distinct chunk encoded once in a worker."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Blanks that do not take part in chunking (code points), and other signs that keep a text whole: doubled blanks, one at the end, ``^``.
_BLANKS = (9, 11, 12, 13, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_ODD = "[" + "".join(f"\\x{{{c:x}}}" for c in _BLANKS) + "^]|[ \\n][ \\n]|[ \\n]$"
#: Entries of the cache, the longest key in it, and the share of misses from which a full cache is started anew.
CACHE_ENTRIES, CACHE_CHARS, STALE = 600_000, 48, 0.6
#: New chunks that are encoded in one call.
TOGETHER = 512
#: Marks that form one piece of their own behind a word.
TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``encode(texts)`` gives for each text its ids and then ``end`` as bytes, two a token (four if the vocabulary needs them).

    ``chunks`` says where texts may be cut without a change of ids:
    ``"led"`` for byte-level vocabularies in which a blank belongs to the word
    after it (cut before each single space or newline), ``"free"`` for those
    that drop blanks and mark word ends with ``</w>`` (cut at ASCII blanks),
    ``"none"`` never. Texts with other or doubled blanks (``led``), or with the
    text of a special token, are not cut. New chunks are encoded many at a time,
    and their ids told apart by the bytes, or word ends, that they stand for.
    """

    def __init__(self, path: str, end: int, chunks: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.code = "H" if max([end, *vocab.values()]) < 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.end = array(self.code, [end]).tobytes()
        self.chunks = chunks
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        #: By id: bytes that a token stands for, or 1 if it ends a word.
        self.counts = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.counts[i] = len(token) if chunks == "led" else token.endswith("</w>")
        special = "|".join(re.escape(x) for x in self.special)
        self.odd = "|".join(x for x in (special, _ODD if chunks == "led" else "") if x)
        self.plain = None
        if chunks == "free":  # for words whose case and form need no normaliser of the library
            from tokenizers import pre_tokenizers as pre

            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = None
            self.plain.pre_tokenizer = pre.Sequence([pre.Split(" ", "removed"), pre.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cache: dict[str, bytes] = {}
        self.letters: dict[str, bool] = {}

    def _is_letter(self, sign: str) -> bool:
        """Whether ``sign`` is a letter or digit and its normalised form ends in one.

        Some letters are decomposed by the normaliser; their last mark would
        form one piece with the marks behind the word.
        """
        found = self.letters.get(sign)
        if found is None:
            form = self.tok.normalizer.normalize_str(sign) if self.tok.normalizer else sign
            found = self.letters[sign] = sign.isalnum() and form[-1:].isalnum()
        return found

    def _encode(self, texts: list[str], tok=None) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in (tok or self.tok).encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, chunks: list[str], counts: list[int]) -> list[bytes]:
        """Ids of chunks whose tokens add up to ``counts``, encoded as one text."""
        raw = self._encode([("" if self.chunks == "led" else " ").join(chunks)], self.plain)[0]
        sums = np.cumsum(self.counts[np.frombuffer(raw, self.dtype)])
        ends = np.cumsum(counts)
        at = np.searchsorted(sums, ends)
        if not len(sums) or sums[-1] != ends[-1] or not np.array_equal(sums[at], ends):
            return self._encode(chunks)  # not as expected: each for itself
        cuts = ((at + 1) * self.dtype.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _new(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of chunks that the cache lacks. The marks behind a word are cut off first, as they are tokens of their own."""
        cache, led = self.cache, self.chunks == "led"
        cut, todo = [], {}
        for k in keys:
            core = k.rstrip(TAIL)
            if len(core) < len(k) and self._is_letter(core[-1:]):
                tail = f"^{k[len(core):]}" if led else k[len(core) :]
                cut.append((k, core, tail))
                if core not in cache:
                    todo[core] = None
                if tail not in cache:
                    todo[tail] = None
            else:
                todo[k] = None
        if led:
            joined = [k for k in todo if k[:1] not in ("^", "")]
            counts = [(len(k) if k.isascii() else len(k.encode("utf-8"))) + (k[0] != "\n") for k in joined]
            shown = [k if k[0] == "\n" else f" {k}" for k in joined]
            alone = [k for k in todo if k[:1] in ("^", "")]
        else:
            joined = [k for k in todo if k.isalpha() and max(k) <= "\xff"]
            counts = [1] * len(joined)
            shown = [k.lower() for k in joined]
            alone = list(todo.keys() - set(joined))
        found = {}
        for i in range(0, len(joined), TOGETHER):
            found.update(zip(joined[i : i + TOGETHER], self._together(shown[i : i + TOGETHER], counts[i : i + TOGETHER]), strict=True))
        found.update(zip(alone, self._encode([self._chunk(k) for k in alone]), strict=True))
        for k, core, tail in cut:
            found[k] = (found[core] if core in found else cache[core]) + (found[tail] if tail in found else cache[tail])
        return found

    def _chunk(self, key: str) -> str:
        """Text of a chunk; in ``led`` the mark ``^`` stands before one that has no blank."""
        if self.chunks == "free":
            return key
        return key[1:] if key[:1] == "^" else key if key[:1] in ("\n", "") else f" {key}"

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Splitting and looking up are done for all words of ``texts`` at once; only distinct words are handled one by one."""
        texts = pc.fill_null(texts, "")
        if self.chunks == "none":
            return [x + self.end for x in self._encode(texts.to_pylist())]
        odd = pc.match_substring_regex(texts, self.odd) if self.odd else pc.equal(texts, None)
        regular = pc.if_else(odd, "", texts)
        if self.chunks == "led":
            lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("^", regular, ""), "\n", " \n"), " ")
        else:
            lists = pc.ascii_split_whitespace(regular)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.cache.get, words))
        missing = [k for k, v in zip(words, ids, strict=True) if v is None]
        if missing:
            found = self._new(missing)
            ids = [found[k] if v is None else v for k, v in zip(words, ids, strict=True)]
            room = CACHE_ENTRIES - len(self.cache)
            if room < len(found) and len(missing) > STALE * len(words):
                self.cache.clear()
            elif room >= len(found):
                self.cache.update({k: v for k, v in found.items() if len(k) <= CACHE_CHARS})
            elif room > 0:
                self.cache.update([(k, v) for k, v in found.items() if len(k) <= CACHE_CHARS][:room])
        joined = pa.array(ids, pa.binary()).take(coded.indices)
        ends = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1, joined.offset * 4) if len(joined) else np.zeros(1, np.int32)
        raw = memoryview(joined.buffers()[2] or b"")
        ends = ends[np.asarray(lists.offsets) - lists.offsets[0].as_py()].tolist()
        out = [raw[a:b].tobytes() + self.end for a, b in zip(ends, ends[1:], strict=False)]
        for i in np.flatnonzero(np.asarray(odd.to_numpy(zero_copy_only=False), bool)).tolist():
            out[i] = self._encode([texts[i].as_py()])[0] + self.end
        return out


def crc_of_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end: int, chunks: str) -> Encoder:
    """The worker's encoder, which its tasks share."""
    key = (path, end, chunks)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def runs(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 22, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most_bytes`` of text each, so that work space does not grow with the batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        size += n
        if size >= most_bytes or i + 1 - start >= most_rows:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < len(sizes):
        yield batch.slice(start)
    # What the work space took goes back to the system, as workers of one machine share its memory and stay alive.
    pa.default_memory_pool().release_unused()

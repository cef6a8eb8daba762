"""Encoding texts piece by piece with a bounded cache, whatever makes the ids."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes a worker's caches take at most, roughly, where not told otherwise; full ones are emptied.
CACHE_BYTES = 256 * 1024**2
#: What an entry takes besides its text and ids.
ENTRY_BYTES = 230
#: Longer pieces of several matches hardly ever occur twice.
SHORT = 10
#: Unseen pieces searched for matches at once.
SEARCHED = 5000


class PieceEncoder:
    """Encodes each match of a pattern on its own; subclasses give the ids of a match.

    The pattern must not match a non-space followed by a space. Ids of matches are
    cached by what follows the space they start with (``later``) or by themselves.
    """

    def __init__(self, pattern: str, cache_bytes: int = CACHE_BYTES):
        self.split = regex.compile(pattern)
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.room = self.cache_bytes = cache_bytes

    def encode_match(self, match: str) -> list[int]:
        raise NotImplementedError

    def remember(self, cache: dict[str, bytes], key: str, ids: bytes) -> None:
        if len(key) < 64:
            self.room -= ENTRY_BYTES + len(key) + len(ids)
            if self.room < 0:
                self.first.clear()
                self.later.clear()
                self.room = self.cache_bytes
            cache[key] = ids

    def new(self, cache: dict[str, bytes], key: str, match: str) -> bytes:
        ids = self.encode_match(match)
        found = pack(f"<{len(ids)}i", *ids)
        if key:  # a lone space is no lead of an empty piece
            self.remember(cache, key, found)
        return found

    def encode_matches(self, matches: list[str]) -> bytes:
        parts = []
        for match in matches:
            cache, key = (self.later, match[1:]) if match[0] == " " else (self.first, match)
            found = cache.get(key) if key else None
            parts.append(self.new(cache, key, match) if found is None else found)
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers.

        A text may be cut where a space follows a non-space, as no match goes
        across; the pieces are encoded (and cached) one by one.
        """
        first, *later = text.split(" ")
        found = [self.first.get(first), *map(self.later.get, later)]
        if None not in found:
            return b"".join(found)
        missed = [i for i, ids in enumerate(found) if ids is None]
        pieces = [later[i - 1] if i else first for i in missed]
        if "" in pieces or any(piece[-1].isspace() for piece in pieces):
            return self.encode_matches(self.split.findall(text))  # several spaces: not a place to cut
        if not missed[0]:
            found[0] = self.encode_matches(self.split.findall(first))
            if len(first) <= SHORT:
                self.remember(self.first, first, found[0])
            missed, pieces = missed[1:], pieces[1:]
        # One search for all pieces: a space starts a piece's first match, and no other.
        if pieces:
            groups: list[list[bytes]] = []
            for match in self.split.findall(" " + " ".join(pieces)):
                if match[0] == " ":
                    key = match[1:]
                    ids = self.later.get(key) if key else None
                    groups.append([self.new(self.later, key, match) if ids is None else ids])
                else:
                    ids = self.first.get(match)
                    groups[-1].append(self.new(self.first, match, match) if ids is None else ids)
            for i, piece, parts in zip(missed, pieces, groups):
                if len(parts) == 1:
                    found[i] = parts[0]
                else:
                    found[i] = ids = b"".join(parts)
                    if len(piece) <= SHORT:
                        self.remember(self.later, piece, ids)
        return b"".join(found)


class RowEncoder(PieceEncoder):
    """Encodes many texts at once; each distinct piece of them is looked up once.

    What is remembered has two generations of half the bytes each: ``first`` and ``later``
    are the younger one, to which pieces in use move. When it is full, it becomes the older
    one, and what that held goes.
    """

    def __init__(self, pattern: str, cache_bytes: int = CACHE_BYTES):
        super().__init__(pattern, cache_bytes // 2)
        self.old_first: dict[str, bytes] = {}
        self.old_later: dict[str, bytes] = {}

    def remember(self, cache: dict[str, bytes], key: str, ids: bytes) -> None:
        if len(key) < 64:
            cache[key] = ids
            self.room -= ENTRY_BYTES + len(key) + len(ids)
            self.turn()

    def remember_all(self, keys: list[str], ids: list[bytes]) -> None:
        """Remember ids of what follows a space."""
        short = [(key, own) for key, own in zip(keys, ids) if 0 < len(key) < 64]
        self.later.update(short)
        self.room -= sum([ENTRY_BYTES + len(key) + len(own) for key, own in short])
        self.turn()

    def turn(self) -> None:
        if self.room < 0:
            self.old_first, self.old_later, self.first, self.later = self.first, self.later, {}, {}
            self.room = self.cache_bytes

    def encode_leads(self, matches: list[str]) -> list[bytes]:
        """Ids of matches that start with a space, not looked up."""
        found = map(self.encode_match, matches)
        return [pack(f"<{len(ids)}i", *ids) for ids in found]

    def ids_of_leads(self, matches: list[str]) -> list[bytes]:
        """Ids of matches that start with a space."""
        keys = [match[1:] for match in matches]
        new, old = self.later.get, self.old_later.get
        found = [new(key) or old(key) for key in keys]
        unseen = [i for i, ids in enumerate(found) if ids is None]
        made = self.encode_leads([matches[i] for i in unseen])
        for i, ids in zip(unseen, made, strict=True):
            found[i] = ids
        self.remember_all([keys[i] for i in unseen], made)
        return found

    def ids_of(self, match: str) -> bytes:
        """Ids of a match that does not start with a space."""
        ids = self.first.get(match)
        if ids is None:
            ids = self.old_first.get(match)
            if ids is None:
                return self.new(self.first, match, match)
            self.remember(self.first, match, ids)
        return ids

    def encode_groups(self, text: str) -> list[list[bytes]]:
        """Ids of a text's matches, in groups that begin before each match that starts with a space."""
        matches = self.split.findall(text)
        leads = iter(self.ids_of_leads([match for match in matches if match[0] == " "]))
        groups: list[list[bytes]] = [[]]
        for match in matches:
            if match[0] == " ":
                groups.append([next(leads)])
            else:
                groups[-1].append(self.ids_of(match))
        return groups

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers, match by match."""
        return b"".join(chain.from_iterable(self.encode_groups(text)))

    def encode_pieces(self, pieces: list[str]) -> list[bytes | None]:
        """Ids of distinct pieces that follow a space; of no use for those that may not be cut off."""
        found = list(map(self.later.get, pieces))
        missed = [i for i, ids in enumerate(found) if ids is None]
        used, unseen = [], []
        for i, ids in zip(missed, map(self.old_later.get, [pieces[i] for i in missed])):
            if ids is not None:
                found[i] = ids
                used.append(i)
            elif pieces[i] and not pieces[i][-1].isspace():
                unseen.append(i)
        # One search for many pieces: a space starts a piece's first match, and no other.
        for at in range(0, len(unseen), SEARCHED):
            some = unseen[at : at + SEARCHED]
            groups = self.encode_groups(" " + " ".join([pieces[i] for i in some]))
            for i, parts in zip(some, groups[1:], strict=True):
                if len(parts) == 1:
                    found[i] = parts[0]
                else:
                    found[i] = b"".join(parts)
                    if len(pieces[i]) <= SHORT:
                        used.append(i)
        self.remember_all([pieces[i] for i in used], [found[i] for i in used])
        return found

    def encode_rows(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text (of type large_string); null texts have none.

        Texts are cut at all spaces, as no match goes across one that follows a non-space.
        Where a space follows white space or ends the text, it is encoded match by match.
        """
        texts = pc.fill_null(texts, "")
        cut = pc.split_pattern(texts, " ")
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(pc.list_value_length(cut).to_numpy(), out=bounds[1:])
        pieces = cut.flatten()
        leads = bounds[:-1]
        follows = np.ones(len(pieces), bool)
        follows[leads] = False
        firsts = pieces.take(pa.array(leads)).to_pylist()
        later = pieces.filter(pa.array(follows)).dictionary_encode()
        bounds -= np.arange(len(bounds))

        distinct = later.dictionary.to_numpy(zero_copy_only=False).tolist()
        uncut = np.array([not piece or piece[-1].isspace() for piece in distinct], bool)
        mixed = np.zeros(len(texts), bool)
        if uncut.any():
            counts = np.concatenate([[0], np.cumsum(uncut[later.indices.to_numpy()])])
            mixed = np.diff(counts[bounds]) > 0
        found = pa.array(self.encode_pieces(distinct), pa.large_binary()).take(later.indices)
        ends = np.zeros(len(found) + 1, np.int64)
        np.cumsum(pc.fill_null(pc.binary_length(found), 0).to_numpy(), out=ends[1:])
        data, ends = memoryview(found.buffers()[2] or b""), ends[bounds].tolist()
        for i, first in enumerate(firsts):
            if mixed[i] or first and first[-1].isspace():
                yield self.encode(texts[i].as_py())
            else:
                lead = self.first.get(first)
                if lead is None:
                    lead = self.encode(first)
                    if len(first) <= SHORT:
                        self.remember(self.first, first, lead)
                yield b"".join([lead, data[ends[i] : ends[i + 1]]])

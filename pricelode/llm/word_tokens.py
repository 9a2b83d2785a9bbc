"""Whole-token shortcut for tokenizers that lower-case, drop white space and mark word ends.

A vocabulary string that provably encodes alone as exactly its own token needs
no merging: it is looked up. Everything else goes through the library's merges
once per distinct string and worker, and is remembered up to a bound.

Why white space is a safe place to cut: the normaliser composes characters and
lower-cases them, neither of which reaches across white space, and no
pre-token holds any. Texts for which Python's and the library's notion of white
space differ, or which may hold special tokens, go to the library whole.
"""

import functools
import re

from tokenizers import Tokenizer

#: Characters that str.split() takes for white space and the library doesn't, and what every special token begins with.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: Pre-tokens of lower-cased Latin-1 strings without white space: contractions, letters, single digits, the rest.
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
#: Distinct strings remembered by one worker beside the proven ones, and once more those of before; a speed bound, results don't depend on it.
MEMO = 400_000
#: Longer strings aren't remembered.
LONGEST = 64
_WORD_END = "</w>"


def _odd(text):
    return any(x in text for x in _ODD)


def _byte_of():
    """{character: byte} of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _plain(token, byte_of):
    """The text that a vocabulary string stands for, or None if its bytes aren't whole characters."""
    try:
        return bytes(byte_of[c] for c in token).decode()
    except (KeyError, UnicodeDecodeError):
        return None


def prove_whole_tokens(tokenizer):
    """{string: id} of the vocabulary's word-ending strings that encode alone as that one token.

    Strings which the normaliser changes or which pre-tokenise into several
    pieces fail the proof, as does any whose merges end elsewhere.
    """
    ends = {token: number for token, number in tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith(_WORD_END)}
    byte_of, found = _byte_of(), {}
    names = [(_plain(token.removesuffix(_WORD_END), byte_of), number) for token, number in ends.items()]
    names = [(name, number) for name, number in names if name and name.split() == [name] and not _odd(name)]
    for (name, number), got in zip(names, tokenizer.encode_batch_fast([n for n, _ in names], add_special_tokens=False), strict=True):
        if got.ids == [number]:
            found[name] = number
    return found


class WordEncoder:
    """Encodes whole texts; `value` turns a list of token ids into what is kept per string."""

    def __init__(self, path, value, join):
        self.tokenizer = Tokenizer.from_file(path)
        self.value, self.join = value, join
        self.whole = {name: value([number]) for name, number in prove_whole_tokens(self.tokenizer).items()}
        self.known, self.older, self.model = dict(self.whole), {}, self.tokenizer.model
        byte_of = _byte_of()
        char_of = {b: c for c, b in byte_of.items()}
        self.spelt = {k: "".join(char_of[b] for b in chr(k).encode()) for k in range(256)}

    def _library(self, text):
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _merged(self, piece):
        # Printable ASCII stands for itself.
        return [t.id for t in self.model.tokenize(piece if piece.isascii() and piece.isprintable() else piece.translate(self.spelt))]

    def _piece(self, piece):
        """For a pre-token; its value is remembered, as words share pieces."""
        found = self.known.get(piece)
        if found is None:
            found = self.older.get(piece)
            if found is None:
                found = self.value(self._merged(piece))
            if len(piece) <= LONGEST:
                self.known[piece] = found
        return found

    def _new_latin(self, word):
        """For a lower-cased Latin-1 string without white space, of which nothing is known."""
        if word.isalpha():
            return self.value(self._merged(word))
        return self.join([self._piece(p) for p in _PIECE.findall(word)])

    def _look_up(self, words, long):
        """Values of the words of a Latin-1 text; new ones are made and remembered, over-long ones only in `long`."""
        found = list(map(self.known.get, words))
        if None in found:
            known, older = self.known, self.older
            for k, value in enumerate(found):
                if value is None:
                    word = words[k]
                    value = known.get(word) or older.get(word)
                    if value is None:
                        value = long.get(word) or self._new_latin(word)
                    (known if len(word) <= LONGEST else long)[word] = value
                    found[k] = value
        return found

    def batch(self, texts):
        """One joined value per text; a null text counts as empty."""
        split, other, long, joined = [], set(), {}, []
        for text in texts:
            words = value = None
            if not text:
                value = self.join(())
            elif not _odd(text):
                try:
                    text.encode("latin-1")  # then the normaliser does nothing but lower-case
                    value = self.join(self._look_up(text.lower().split(), long))
                except UnicodeEncodeError:
                    words = text.split()
                    other.update(words)
            split.append(words)
            joined.append(value)
        rest = []
        for word in other.difference(self.known):
            value = self.older.get(word)
            if value is None:
                rest.append(word)
            else:
                self.known[word] = value
        for word, got in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[word] = self.value(got.ids)
        for k, (words, text) in enumerate(zip(split, texts, strict=True)):
            if joined[k] is None:
                joined[k] = self.value(self._library(text)) if words is None else self.join(map(self.known.__getitem__, words))
        for word in rest:
            if len(word) > LONGEST:
                del self.known[word]
        if len(self.known) > MEMO + len(self.whole):
            self.known, self.older = dict(self.whole), self.known
        return joined


@functools.lru_cache(maxsize=1)
def worker_encoder(path, value, join):
    """The encoder of this worker process, kept from task to task with its proofs and what it remembers.

    value and join must be functions of a module, so that they are the same in each task.
    """
    return WordEncoder(path, value, join)

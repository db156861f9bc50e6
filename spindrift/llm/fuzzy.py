"""A lexicon trie intersected with Levenshtein automata, made deterministic as it is used."""

from __future__ import annotations


class FuzzyTrie:
    """Finds words within one edit of a term, or that begin so with a stem.

    terms: term to whether it is a stem (any ending may follow). A state is the set of
    (trie node, edits used) an automaton of all terms can be in; steps are found once and
    remembered. A word that fits no term leaves the automaton after a few letters.
    never: words that are no near forms, such as common words one edit away from a short term; exact: terms without near forms.
    """

    EXACT, NEAR = 0, 1

    def __init__(self, terms: dict[str, bool], least_near: int = 1, never: frozenset[str] = frozenset(), exact: frozenset[str] = frozenset()):
        self.terms = dict(sorted(terms.items()))
        self.least_near = least_near
        self.never, self.exact = never, exact
        self._next: list[dict[str, int]] = [{}]
        self._whole: list[str | None] = [None]
        self._stem: list[str | None] = [None]
        for t, stem in self.terms.items():
            node = 0
            for c in t:
                if c not in self._next[node]:
                    self._next[node][c] = len(self._next)
                    self._next.append({}), self._whole.append(None), self._stem.append(None)
                node = self._next[node][c]
            (self._stem if stem else self._whole)[node] = t
        self._sets: list[frozenset[tuple[int, int]]] = []
        self._number: dict[frozenset[tuple[int, int]], int] = {}
        self._step: list[dict[str, int]] = []
        self._final: list[tuple[int, str] | None] = []
        self._begun: list[tuple[int, str] | None] = []
        self._start = self._state(self._skipped({(0, 0)}))

    def _skipped(self, members: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """Also what is reached by leaving out letters of terms."""
        return frozenset(members | {(k, 1) for node, e in members if not e for k in self._next[node].values()})

    def _state(self, members: frozenset[tuple[int, int]]) -> int:
        if members not in self._number:
            self._number[members] = len(self._sets)
            self._sets.append(members)
            self._step.append({})
            for out, names in ((self._final, self._whole), (self._begun, self._stem)):
                ends = sorted((e, names[node]) for node, e in members if names[node] and (not e or (len(names[node]) >= self.least_near and names[node] not in self.exact)))
                out.append(ends[0] if ends else None)
        return self._number[members]

    def _move(self, state: int, c: str) -> int:
        to: set[tuple[int, int]] = set()
        for node, e in self._sets[state]:
            follow = self._next[node]
            if c in follow:
                to.add((follow[c], e))
            if not e:
                to.add((node, 1))  # a letter too many
                to.update((k, 1) for k in follow.values())  # another letter
        self._step[state][c] = n = self._state(self._skipped(to)) if to else -1
        return n

    def find(self, word: str) -> tuple[int, str] | None:
        """(EXACT or NEAR, term) of the best match, or None."""
        found = self._best(word)
        return None if found is not None and found[0] == self.NEAR and word in self.never else found

    def _best(self, word: str) -> tuple[int, str] | None:
        state, best = self._start, self._begun[self._start]
        for c in word:
            to = self._step[state].get(c)
            if to is None:
                to = self._move(state, c)
            if to < 0:
                return best
            state = to
            begun = self._begun[state]
            if begun is not None and (best is None or begun < best):
                best = begun
        whole = self._final[state]
        return whole if whole is not None and (best is None or whole < best) else best

"""A Levenshtein automaton run along a trie of terms, made deterministic as it is used."""

from __future__ import annotations

from array import array

#: Room for the code point of a letter.
_LETTER = (1 << 21) - 1


class LexiconAutomaton:
    """Finds the closest lexicon term of a word within the edits that the term's length allows.

    A state is a set of (trie node, edits so far, pending letter): the positions in the trie that a
    word read so far can have. A pending letter is the second half of a swap of two neighbours,
    which counts as one edit. Each new state and step is worked out once and kept, until there are
    ``most_states``; then all are forgotten, which changes time and never results.
    """

    def __init__(self, terms: list[str], edits, most_states: int = 100_000):
        """``edits`` maps the length of a term to the edits it allows."""
        self.terms, self.most_states = terms, most_states
        self.child: list[dict[str, int]] = [{}]
        self.term_at: dict[int, int] = {}
        self.allows: list[int] = [0]
        for t, term in enumerate(terms):
            node = 0
            for c in term:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.allows.append(0)
                self.allows[node] = max(self.allows[node], edits(len(term)))
                node = self.child[node][c]
            self.allows[node] = max(self.allows[node], edits(len(term)))
            self.term_at[node] = t
        self.edits = edits
        self._forget()

    def _forget(self) -> None:
        #: A state's positions as packed numbers, and the states after a state and a letter, both flat to be small.
        self.members: list[bytes] = []
        self.number: dict[bytes, int] = {}
        self.steps: dict[int, int] = {}
        self.accepts: list[tuple[int, int] | None] = []
        self.dead = self._state(set())
        self.start = self._state({(0, 0, 0)})

    def _state(self, items: set) -> int:
        """The number of the state of these (node, edits, code of the pending letter or 0)."""
        queue = list(items)
        while queue:  # a letter of the term may be missing
            node, e, pending = queue.pop()
            if not pending:
                for down in self.child[node].values():
                    item = (down, e + 1, 0)
                    if e + 1 <= self.allows[down] and item not in items:
                        items.add(item)
                        queue.append(item)
        best: dict[int, int] = {}
        for node, e, pending in items:
            place = node << 21 | pending
            best[place] = min(e, best.get(place, e))
        key = array("q", sorted(place << 8 | e for place, e in best.items())).tobytes()
        if key not in self.number:
            self.number[key] = len(self.members)
            self.members.append(key)
            ends = [(e, self.term_at[place >> 21]) for place, e in best.items() if not place & _LETTER and place >> 21 in self.term_at and e <= self.edits(len(self.terms[self.term_at[place >> 21]]))]
            self.accepts.append(min(ends) if ends else None)
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        after, code = set(), ord(c)
        for packed in array("q", self.members[state]):
            node, e, pending = packed >> 29, packed & 0xFF, packed >> 8 & _LETTER
            if pending:
                if code == pending:
                    after.add((node, e, 0))
                continue
            child = self.child[node]
            if c in child:
                after.add((child[c], e, 0))
            if e < self.allows[node]:
                after.add((node, e + 1, 0))
                for letter, down in child.items():
                    after.add((down, e + 1, 0))
                    if letter != c and c in self.child[down]:
                        after.add((self.child[down][c], e + 1, ord(letter)))
        self.steps[state << 21 | code] = found = self._state({x for x in after if x[1] <= self.allows[x[0]]})
        return found

    def closest(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the closest term, the first of equals; None if there is none."""
        if len(self.members) > self.most_states:
            self._forget()
        state, steps, dead = self.start, self.steps, self.dead
        for c in word:
            after = steps.get(state << 21 | ord(c))
            state = self._step(state, c) if after is None else after
            if state == dead:
                return None
        return self.accepts[state]

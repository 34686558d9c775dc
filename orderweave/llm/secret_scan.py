"""Secret scans by one combined automaton.

All rules are compiled into one minimal DFA that reads a text's bytes once and says where which rule can end.
From there, that rule's reversed automaton finds the leftmost start and its forward automaton the furthest end;
matches of a rule don't overlap, and one that is too short uses up its bytes and is dropped. Texts are scanned by
``mapInArrow`` where they are read: no shuffle, one text at a time.

Defined results: a null text is empty and has no secret; a repeated row is scanned again; a text of any length
is read whole; positions count code points; an empty table gives an empty result; other columns are ignored by
``secret_spans`` and kept by ``redact_secrets``, in which a null text stays null and a text without a secret is
unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from orderweave.llm.byte_automaton import Automaton, parse, reverse
from orderweave.llm.common import map_rows, table, tidy

# Kind, pattern, whether letters match in either case, least length, and the group it is measured on (0: all).
BASE_RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 6, 2),
    ("access", r"AKIA[A-Z0-9]+", False, 20, 0),
    ("hex", r"[0-9a-f]+", False, 24, 0),
]
MORE_RULES = [
    ("private_key", r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----([A-Za-z0-9+/=\x20\x09\x0A\x0D]*-----END ([A-Z0-9]+ )*PRIVATE KEY-----)?", False, 0, 0),
    ("web_token", r"eyJhbGciOi[A-Za-z0-9._-]+", False, 40, 0),
    ("host_token", r"gh[pousr]_[A-Za-z0-9]+", False, 40, 0),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", False, 15, 0),
    ("cloud_key", r"AIza[A-Za-z0-9_-]+", False, 39, 0),
]
RULES = BASE_RULES + MORE_RULES
KINDS = [r[0] for r in RULES]


class Scanner:
    """The automata of a list of rules."""

    def __init__(self, rules: list[tuple[str, str, bool, int, int]] = RULES):
        self.rules = rules
        trees = [parse(p, fold) for _, p, fold, _, _ in rules]
        seek = [self._trigger(t, least) for t, (_, _, _, least, _) in zip(trees, rules, strict=True)]
        self.all = Automaton(seek, floating=True)
        self.forward = [Automaton([t], floating=False) for t in trees]
        self.backward = [Automaton([reverse(t)], floating=False) for t in trees]
        # The exact check of a group's length reads the span of a match alone.
        self.group = [re.compile(p.encode(), re.IGNORECASE if fold else 0) if group else None for _, p, fold, _, group in rules]

    @staticmethod
    def _trigger(tree: tuple, least: int) -> tuple:
        """What the combined automaton looks for: a last ``+`` once, and of a bare run of one class its least length.

        Without the loops behind a match, states needn't remember which runs they are in.
        """
        *head, last = tree[1] if tree[0] == "cat" else [tree]
        if last[0] != "rep" or last[2:] != (1, None):
            return tree
        return ("cat", [*head, last[1]]) if head else ("rep", last[1], least, least)

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start, then rule."""
        ends: dict[int, list[tuple[int, int]]] = {}
        for first, last, state in self.all.scan(data):
            for rule in self.all.accepts[state]:
                ends.setdefault(rule, []).append((first, last))
        out = []
        for rule, found in ends.items():
            _, _, _, least, group = self.rules[rule]
            floor = 0
            for end, last in found:
                while (end := max(end, floor + 1)) <= last:
                    start = self.backward[rule].longest(data, end, floor, -1)
                    if start is None:
                        end += 1
                        continue
                    stop = self.forward[rule].longest(data, start, len(data))
                    floor = stop
                    length = stop - start if not group else len(self.group[rule].fullmatch(data, start, stop)[group])
                    if length >= least:
                        out.append((start, rule, stop))
        return sorted(out)

    def text_spans(self, text: str) -> list[tuple[int, int, int]]:
        """The same in code points."""
        data = text.encode("utf-8", "surrogatepass")
        found = self.spans(data)
        if not found or len(data) == len(text):
            return found
        marks = sorted({p for a, _, b in found for p in (a, b)})
        at, last, chars = {}, 0, 0
        for p in marks:
            chars += len(data[last:p].decode("utf-8", "surrogatepass"))
            at[p], last = chars, p
        return [(at[a], rule, at[b]) for a, rule, b in found]


@lru_cache(maxsize=4)
def _scanner(rules: tuple) -> Scanner:
    return Scanner(list(rules))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row the counts of the base kinds, their digest, and all spans."""
    n_base = len(BASE_RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(tuple(RULES))
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                found = scanner.text_spans(text or "")
                base = [x for x in found if x[1] < n_base]
                counts = [sum(x[1] == k for x in base) for k in range(n_base)]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * (n_base + 2)
            types = [pa.int64()] * n_base + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(tidy(run), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """``text`` with each maximal run of spans, which may overlap, replaced by ``mask``."""
    out, at, upto = [], 0, -1
    for a, _, b in spans:
        if a > upto or upto < 0:
            out += [text[at:a], mask]
        at = upto = max(b, upto)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every secret masked, and the length column, if there is one, set anew for texts that changed."""
    names = docs.columns
    at, length_at = names.index(text_col), names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(tuple(RULES))
        for batch in batches:
            texts, columns = batch.column(at).to_pylist(), list(batch.columns)
            lengths = batch.column(length_at).to_pylist() if length_at is not None else []
            for i, text in enumerate(texts):
                if text and (found := scanner.text_spans(text)):
                    texts[i] = redact(text, found, mask)
                    if length_at is not None:
                        lengths[i] = len(texts[i])
            columns[at] = pa.array(texts, pa.string())
            if length_at is not None:
                columns[length_at] = pa.array(lengths, batch.schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_rows(docs, run)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over every whole text of ``documents``."""
    return secret_spans(table(spark, sf_dir, "documents"))

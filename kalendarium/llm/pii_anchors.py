"""Personal data by anchor expansion (operator 7).

An Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, URL schemes and identifier cues.
At each anchor a local parser expands to the boundaries of a candidate and validates it; no pattern is
run over the text as a whole. The parsers give what the leftmost non-overlapping matches of the base
patterns give: email, ip, card, phone. The anchors add url (scheme up to white space or a quote), iban
(cue, then a number with valid check digits) and account (cue, then 6 to 20 digits).

Rows: a null text is empty and has no spans; every other row, repeated ones included, is parsed whole.
No shuffle: the work is one pass over the rows, whatever ids or sources are hot.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalendarium.llm.common import per_worker, small_batches, text_of

#: in the order in which spans that start together are listed
KINDS = ("email", "ip", "card", "phone", "url", "iban", "account")
#: schemes and cues count in either case
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = {"iban": "iban", "account": "account", "konto": "account", "a/c": "account"}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_SPACED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s\"'<>]+")
_IBAN = re.compile(r"[\x20:=#.]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?:\x20?(?i:number|no\.?|nr\.?|nummer))?[\x20:=#.]{1,4}([0-9](?:[\x20-]?[0-9]){5,19})(?![0-9])", re.ASCII)
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    moved = text[4:] + text[:4]
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _lowered(text: str) -> str:
    """Lower-cased at equal length: the few letters that grow send the text the slower way, where only A-Z change."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate({c: c + 32 for c in range(65, 91)})


class _Parser:
    def __init__(self):
        import ahocorasick

        self.anchors = ahocorasick.Automaton()
        for c in "@+":
            self.anchors.add_word(c, (c, 1))
        for c in "0123456789":
            self.anchors.add_word(c, ("0", 1))
        for s in SCHEMES:
            self.anchors.add_word(s, ("url", len(s)))
        for cue, kind in CUES.items():
            self.anchors.add_word(cue, (kind, len(cue)))
        self.anchors.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        found: list[tuple[str, int, int]] = []
        done = dict.fromkeys(("@", "+", "dotted", "spaced", "url", "iban", "account"), 0)
        for last, (cue, size) in self.anchors.iter(_lowered(text)):
            at = last - size + 1
            if cue == "0":
                # an anchor inside a parsed candidate adds nothing
                if at >= done["dotted"]:
                    done["dotted"] = self._addresses(text, at, found)
                if at >= done["spaced"]:
                    done["spaced"] = self._card(text, at, found)
            elif cue == "@":
                start = at
                while start > done["@"] and text[start - 1] in _LOCAL:
                    start -= 1
                domain = _DOMAIN.match(text, at + 1) if start < at else None
                if domain:
                    found.append(("email", start, domain.end()))
                    done["@"] = domain.end()
            elif cue == "+":
                phone = _PHONE.match(text, at) if at >= done["+"] else None
                if phone:
                    done["+"] = phone.end()
                    if 10 <= sum(c in _DIGITS for c in phone[0]) <= 15:
                        found.append(("phone", at, phone.end()))
            elif cue == "url":
                if at >= done["url"]:
                    end = _URL.match(text, at).end()
                    found.append(("url", at, end))
                    done["url"] = end
            elif at >= done[cue]:
                self._cued(cue, text, last + 1, found, done)
        place = {k: i for i, k in enumerate(KINDS)}
        return sorted(found, key=lambda s: (s[1], place[s[0]], s[2]))

    @staticmethod
    def _addresses(text: str, at: int, found: list) -> int:
        """A chain of dotted numbers holds an address per four of its parts."""
        chain = _DOTTED.match(text, at)
        end = chain.end()
        if end - at >= 7 and "." in chain[0]:
            parts, start = chain[0].split("."), at
            for i in range(0, len(parts) - 3, 4):
                stop = start + sum(map(len, parts[i:i + 4])) + 3
                # leading zeros count for nothing; no part of more than three other digits is tried as a number
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i:i + 4]):
                    found.append(("ip", start, stop))
                start = stop + 1
        return end

    @staticmethod
    def _card(text: str, at: int, found: list) -> int:
        run = _SPACED.match(text, at)
        if not run:
            return at + 1
        if run.end() - at >= 14:
            digits = _NOT_DIGIT.sub("", run[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", at, run.end()))
        return run.end()

    @staticmethod
    def _cued(cue: str, text: str, at: int, found: list, done: dict) -> None:
        hit = (_IBAN if cue == "iban" else _ACCOUNT).match(text, at)
        if hit and cue == "account":
            found.append(("account", hit.start(1), hit.end(1)))
            done[cue] = hit.end()
        elif hit:
            # the longest head whose check digits are right
            for end in range(hit.end(1), hit.start(1) + 14, -1):
                if text[end - 1] != " " and iban_valid(text[hit.start(1):end].replace(" ", "")):
                    found.append(("iban", hit.start(1), end))
                    done[cue] = end
                    break


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of one text, in code points, by start, then in the order of KINDS."""
    return per_worker("pii-parser", _Parser).spans(text)


def _parse(batches):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t)] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and its spans (kind, start, end)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(_parse, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

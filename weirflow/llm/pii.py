"""Personal data by weak supervision.

Base spans are those of four fixed patterns with their checks; they always stay. Looser
patterns propose more spans: emails and addresses written out of the way of harvesters, IPv6
addresses, cards with other marks between the digits, telephone numbers without a plus.
Labelers vote yes, no or nothing on every span, base or proposed: the strict pattern, the form
of its parts (a checksum for cards), gazetteers of domains, prefixes and reserved numbers, words
before it that speak for it, words that speak against it, and letters or digits that touch it.
Spans are counted over the whole corpus by pattern of votes; expectation-maximisation estimates
from the counts how far each labeler can be relied on (see reliabilities) and how likely each pattern of votes is to be personal data; and a logistic span classifier is trained
on these probabilities, with kind, votes, length and marks of a span, base and proposed spans
weighing half each. A proposed span is added if the classifier says so and no base span of any
kind overlaps it.

What the classifier sees of a span is one small number (its signature), so the corpus's counts
are a table of bounded size, and only that goes through the driver.

Defined results: null and empty texts have no spans; spans of different kinds may overlap;
repeated rows have equal results; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, settle, texts

KINDS = ("email", "ip", "card", "phone")

#: The letters before an email's @, and the base patterns of the other parts. A
#: number begins where no digit stands before it, as each leftmost match does.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Proposals: kind, pattern, and strings of which one is in every text with a match.
LOOSE = (
    (0, re.compile(r"[A-Za-z0-9._+-]{1,64}\x20?[(\[{]at[)\]}]\x20?[A-Za-z0-9-]{1,63}(?:(?:\x20?[(\[{]dot[)\]}]\x20?|\.)[A-Za-z0-9-]{1,63})+"), ("(at)", "[at]", "{at}")),
    (0, re.compile(r"[A-Za-z0-9._+-]{1,64}\x20at\x20[A-Za-z0-9-]{1,63}(?:\x20dot\x20[A-Za-z0-9-]{1,63})+"), (" dot ",)),
    (1, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"), (":",)),
    (1, re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){3}(?![0-9])"), ("[.]", "(.)", "[dot]")),
    (2, re.compile(r"(?<![0-9./_])[0-9]{4}(?:[./_][0-9]{4}){3}(?![./_]?[0-9])"), (".", "/", "_")),
    (3, re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![.-]?[0-9])"), ("-", ".", " ")),
    (3, re.compile(r"(?<![0-9+])00[1-9][0-9]?[\x20./-][0-9]{2,4}(?:[\x20./-][0-9]{2,5}){1,3}(?![0-9])"), ("00",)),
)

ENDINGS = frozenset("com org net edu gov mil int info biz io de fr es it nl be ch at uk us ca au jp eu".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "6011", "65", "35", "36", "38")
FOR = (frozenset("email e-mail mail contact write courriel correo reply".split()), frozenset("ip host server address addr from client".split()), frozenset("card visa mastercard amex credit payment karte carte tarjeta".split()), frozenset("phone tel telephone call mobile cell fax telefon téléphone teléfono".split()))
AGAINST = frozenset("version release build section chapter isbn issn doi order invoice id sku page figure table price".split())
WORDS = re.compile(r"[^\W\d_][\w-]*")

LABELERS = 6
#: How often each labeler that votes is thought to say yes of no and of yes before any count, which weighs as BELIEF votes do.
SAYS_YES, BELIEF = np.asarray([[0.1, 0.45, 0.45, 0.25, 0.5, 0.5], [0.9, 0.55, 0.55, 0.75, 0.98, 0.98]]), 20.0
#: Labelers that only ever say no: their silence is a yes.
OBJECTORS = [4, 5]
VOTES = 3**LABELERS
#: Bits of a span's form: long, marks of more than one kind, brackets.
FORM_BITS = 3
FORMS = 2**FORM_BITS


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping emails, found from each @: time is in proportion to the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    first = DIGIT.search(text)
    if first is None:
        return out
    at = first.start()
    out += [(1, *m.span()) for m in IP.finditer(text, at) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text, at):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text, max(0, at - 1)) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def proposed(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the looser patterns that overlap no base span and no earlier proposal of their kind, by kind and start."""
    first = DIGIT.search(text)
    found = []
    for kind, pattern, marks in LOOSE:
        if kind and first is None or not any(m in text for m in marks) or marks == (":",) and text.count(":") < 7:
            continue
        found += [(kind, *m.span()) for m in pattern.finditer(text, max(0, first.start() - 5) if kind and first else 0)]
    if not found:
        return []
    starts, ends = [], []  # what base spans cover, in order
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a <= ends[-1]:
            ends[-1] = max(b, ends[-1])
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for kind, a, b in sorted(found):
        before = bisect_left(starts, b) - 1
        if (before < 0 or ends[before] <= a) and not (out and out[-1][0] == kind and a < out[-1][2]):
            out.append((kind, a, b))
    return out


def signature(text: str, kind: int, start: int, end: int, strict: bool) -> int:
    """Kind, votes and form as one number."""
    said, before = text[start:end], [w.lower() for w in WORDS.findall(text[max(0, start - 48) : start])][-5:]
    digits = re.sub(r"\D", "", said)
    votes = [1 if strict else 0]
    if kind == 0:
        domain = re.split(r"@|\bat\b", said)[-1]
        parts = [p for p in re.split(r"[.\s()\[\]{}]+|\bdot\b", domain) if p]
        votes += [1 if 2 <= len(said) <= 254 and ".." not in said else -1, 1 if parts and parts[-1].lower() in ENDINGS else -1]
    elif kind == 1:
        parts = re.findall("[0-9A-Fa-f]+", said)
        six = ":" in said
        votes += [1 if six or all(int(p) <= 255 and p == str(int(p)) for p in parts if p.isdecimal()) else -1, -1 if said.startswith(("0.", "127.", "255.", "0[", "127[", "255[")) or six and len(set(parts)) < 3 else 1]
    elif kind == 2:
        votes += [1 if luhn(digits) else -1, 1 if digits.startswith(ISSUERS) else -1]
    else:
        votes += [1 if 9 <= len(digits) <= 15 else -1, -1 if len(set(digits)) < 3 or digits[:3] == "000" and not strict else 1]
    votes += [1 if FOR[kind].intersection(before) else 0, -1 if AGAINST.intersection(before) else 0]
    touched = start > 0 and text[start - 1].isalnum() or end < len(text) and text[end].isalnum()
    votes += [-1 if touched else 0]
    code = 0
    for v in votes:
        code = code * 3 + v + 1
    marks = set(re.sub(r"[\w@]", "", said))
    form = (end - start > 16) + 2 * (len(marks) > 1) + 4 * bool(marks & set("()[]{}"))
    return (kind * VOTES + code) * FORMS + form


def votes_of(signatures: np.ndarray) -> np.ndarray:
    code = signatures // FORMS % VOTES
    return np.stack([code // 3**k % 3 - 1 for k in range(LABELERS - 1, -1, -1)], 1)


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over patterns of votes with counts n: the probability that each pattern is personal data, and of a yes of each labeler that votes given no and yes.

    An abstention says nothing, but for labelers that only say no. Base and proposed spans have a
    share of personal data each.
    """
    heard = votes.copy()
    heard[:, OBJECTORS] = np.where(votes[:, OBJECTORS] < 0, -1, 1)
    yes_vote, no_vote = (heard == 1).astype(float), (heard == -1).astype(float)
    base, table, prior = votes[:, 0] == 1, SAYS_YES, np.full(len(votes), 0.5)
    p = np.zeros(len(votes))
    for _ in range(rounds):
        logs = [np.log(q) + yes_vote @ np.log(t) + no_vote @ np.log(1 - t) for q, t in zip((1 - prior, prior), table, strict=True)]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(new - p).max() < 1e-9:
            break
        p, yes, no = new, n * new, n * (1 - new)
        table = np.stack([(w @ yes_vote + said * BELIEF) / (w @ (yes_vote + no_vote) + BELIEF) for w, said in zip((no, yes), SAYS_YES, strict=True)])
        share = [(float(yes[side].sum()) + 1) / (float(n[side].sum()) + 2) for side in (~base, base)]
        prior = np.where(base, share[1], share[0])
    return p, table


def span_features(signatures: np.ndarray) -> np.ndarray:
    """Kind, each labeler's yes and no but the strict one's, and form, as numbers 0 and 1; and a constant. What the strict pattern says is left out, for it says nothing of proposed spans."""
    kind, form, v = signatures // FORMS // VOTES, signatures % FORMS, votes_of(signatures)[:, 1:]
    return np.concatenate([np.ones((len(v), 1)), kind[:, None] == np.arange(len(KINDS)), v == 1, v == -1, (form[:, None] >> np.arange(FORM_BITS)) & 1], 1).astype(float)


def span_classifier(signatures: np.ndarray, n: np.ndarray, p: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weights of logistic regression on the probabilities, by Newton steps. Only shares of spans count, not their number: base and proposed ones have half each."""
    x, base = span_features(signatures), votes_of(signatures)[:, 0] == 1
    weight = n.astype(float)
    for side in (base, ~base):
        weight[side] *= 500 / max(1.0, weight[side].sum())
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * q * (1 - q))[:, None]) + 0.1 * np.eye(len(w)), x.T @ (weight * (p - q)) - 0.1 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added) of each document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("signature", pa.int32())])

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, more = [], []
        for text in texts(batch.column(1)):
            base = base_spans(text)
            kept.append([{"kind": k, "start": a, "end": b, "signature": signature(text, k, a, b, True)} for k, a, b in base])
            more.append([{"kind": k, "start": a, "end": b, "signature": signature(text, k, a, b, False)} for k, a, b in proposed(text, base)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.list_(span)), pa.array(more, pa.list_(span))], ["doc_id", "base", "more"])

    kind = "array<struct<kind:int,start:long,end:long,signature:int>>"
    seen = settle(docs.select("doc_id", "text").mapInArrow(by_batch(look), f"doc_id {id_type}, base {kind}, more {kind}"))
    counts = seen.select(F.explode(F.concat("base", "more")).alias("s")).groupBy("s.signature").agg(F.count(F.lit(1)).alias("n")).collect()
    added: list[int] = []
    if counts:
        signatures, n = np.asarray([r["signature"] for r in counts]), np.asarray([r["n"] for r in counts], float)
        p, _ = reliabilities(votes_of(signatures), n)
        w = span_classifier(signatures, n, p)
        added = sorted(signatures[span_features(signatures) @ w >= 0].tolist())
    accepted = F.filter("more", lambda s: s["signature"].isin(added)) if added else F.filter("more", lambda s: F.lit(False))
    names = F.array(*map(F.lit, KINDS))

    def joined(spans):
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"])))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def counted(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    own = [counted(k) for k in range(len(KINDS))]
    return seen.select("doc_id", *own, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat(F.col("base"), accepted)).alias("spans"))

"""Personal data by weak supervision.

Candidates: the fixed patterns (email, ip, card, phone) and looser ones (national phone numbers, ssn, iban, spelled-out
emails, names after a title). Five labelers vote yes, no or nothing on each: the strict form, a check of validity
(checksums, ranges), a gazetteer (top-level domains, calling codes, card and country prefixes, first names), the words
around it, and its borders. The votes of the whole corpus are counted by pattern (kind and votes; their number does not
depend on the corpus), expectation-maximisation estimates every labeler's reliability and every kind's share, and a
logistic classifier is fitted to the posteriors. Candidates it accepts become spans; spans of the fixed patterns stay
in any case, and others never overlap them.

Spans are kind:start:end in code points, by start, then kind. Nulls: a null text is empty; a null doc_id is an id of
its own. Repeated rows count each. A text is held by one task and read once for each kind. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import arrow_map, keyed_documents, written

# The patterns of the contract, in their order.
BASE = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

MORE = ("national", "ssn", "iban", "spelled", "person")
LOOSE = {
    "national": re.compile(r"(?<![\w+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "spelled": re.compile(r"(?<!\S)[A-Za-z0-9._-]{2,40} ?[\[(]at[\])] ?[A-Za-z0-9-]{2,40}(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{2,20})+", re.I),
    "person": re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr)\.? [A-Z][a-z]+ [A-Z][a-z]+(?!\w)"),
}
NEAR = re.compile(r"\b(e-?mail|mail|contact|call|phone|tel|mobile|fax|card|visa|credit|ssn|social|iban|account|ip|address|host|born|name|reach)\b", re.I)
NOT = re.compile(r"\b(version|v|isbn|issn|order|page|section|chapter|license|licence|build|release|figure|table|no)\b", re.I)
# Fixed values of the gazetteer: top-level domains of general use and of countries, calling codes, the first digits of
# card issuers, national identifiers of IBANs, and given names, by public lists.
GENERIC = "com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel tel cat asia post xxx app dev io ai co me tv online site shop store blog cloud tech xyz top club live news email"
#: Two letters are a country's domain but for the codes left to users (aa, qm to qz, xa to xz, zz).
COUNTRY = re.compile(r"(?!aa|q[m-z]|x|zz)[a-z]{2}")
DOMAINS = frozenset(GENERIC.split())
#: Calling codes of the numbering plan: of one digit, of two, and the zones of those of three.
CALLING = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(2[1-69]|3[578]|42|5[09]|6[789]|8[0578]|9[679])[0-9]")
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[0457689]|6[0-9]")
IBANS = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26}
NAMES = frozenset(
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Karen Charles Sarah Christopher Lisa Daniel Nancy Matthew Sandra Anthony Ashley Mark Emily "
    "Steven Kimberly Andrew Margaret Paul Donna Joshua Michelle Kenneth Carol Kevin Amanda Brian Melissa George Deborah Timothy Stephanie Ronald Rebecca Jason Sharon Edward Laura Jeffrey Cynthia Ryan Amy Jacob Kathleen "
    "Anna Maria Peter Julia Sophie Carlos Lucia Pierre Claire Hans Emma Jean Marie Louis Camille Nicolas Philippe Jose Carmen Juan Antonio Francisco Manuel Isabel Ana Pedro Miguel Luis Pablo Elena Sofia "
    "Klaus Sabine Wolfgang Monika Stefan Petra Andreas Ursula Jan Piet Ingrid Lars Erik Astrid Giovanni Giulia Marco Chiara Luca Francesca Ivan Olga Sergei Natalia Dmitri Tatiana Wei Li Ming Yuki Hiroshi Kenji "
    "Ahmed Fatima Mohammed Aisha Omar Layla Ali Hassan Raj Priya Amit Anjali Sanjay Deepa".split()
)
REACH = 40
YES, NO = 1, 2


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, not overlapping; from every at sign outwards, so that long runs cost one pass."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > last and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    return out


def fixed(text: str) -> list[tuple[int, int, str]]:
    out = [(s, e, "email") for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
                out.append((*m.span(), "ip"))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((*m.span(), "phone"))
    order = {k: i for i, k in enumerate((*BASE, *MORE))}
    return sorted(out, key=lambda x: (x[0], order[x[2]]))


def loose(text: str, base: list) -> list[tuple[int, int, str]]:
    out = []
    taken = _merged([(s, e) for s, e, _ in base])
    digits = bool(DIGIT.search(text))
    low = text.lower() if "at]" in text or "at)" in text or "AT]" in text or "AT)" in text else ""
    for kind in MORE:
        if kind in ("national", "ssn", "iban") and not digits or kind == "spelled" and not low or kind == "person" and not ("Mr" in text or "Ms" in text or "Dr" in text):
            continue
        found = [m.span() for m in LOOSE[kind].finditer(text)]
        free = [x for x in found if not _overlaps(taken, *x)]
        out += [(s, e, kind) for s, e in free]
        if free:
            taken = _merged([*taken, *free])
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint stretches, in order, that cover the same places."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _overlaps(taken: list[tuple[int, int]], s: int, e: int) -> bool:
    i = bisect.bisect_left(taken, (e,))  # the stretches before begin before e
    return i > 0 and taken[i - 1][1] > s


def votes(text: str, s: int, e: int, kind: str) -> tuple[int, int, int, int, int]:
    """Form, validity, gazetteer, context and borders."""
    own = text[s:e]
    digits = re.sub(r"[^0-9]", "", own)
    form = YES if kind in ("email", "card", "phone", "ssn", "iban", "spelled") else 0
    valid = gazetteer = 0
    if kind in ("email", "spelled"):
        domain = re.split(r"[^a-z]+", own.lower())[-1]
        gazetteer = YES if domain in DOMAINS or COUNTRY.fullmatch(domain) else NO
        valid = NO if ".." in own or own[0] == "." else YES
    elif kind == "ip":
        parts = [int(x.lstrip("0") or 0) for x in own.split(".")]
        valid = YES if 0 < parts[0] < 240 and parts[-1] != 0 else NO
        form = YES if all(len(x) <= 3 for x in own.split(".")) else NO
    elif kind == "card":
        valid = YES
        gazetteer = YES if ISSUERS.match(digits) else NO
    elif kind == "phone":
        valid = YES
        gazetteer = YES if CALLING.match(digits) else NO
    elif kind == "national":
        valid = YES if digits[0] not in "01" and digits[3] not in "01" else NO
    elif kind == "ssn":
        valid = NO if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else YES
    elif kind == "iban":
        bare = own.replace(" ", "")
        valid = YES if int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1 else NO
        gazetteer = YES if IBANS.get(bare[:2]) == len(bare) else NO
    elif kind == "person":
        gazetteer = YES if own.split()[1] in NAMES else NO
        form = YES
    around = text[max(0, s - REACH) : s]
    context = YES if NEAR.search(around) else NO if NOT.search(around[-12:]) else 0
    glued = s > 0 and text[s - 1].isalnum() or e < len(text) and text[e].isalnum()
    return form, valid, gazetteer, context, NO if glued else YES


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (fixed spans, joined) and found array<kind, start, end, votes>."""

    def scan(batches):
        for b in batches:
            counts, base, found = [], [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                own = fixed(text)
                counts.append([sum(x[2] == k for x in own) for k in BASE])
                base.append(",".join(f"{k}:{s}:{e}" for s, e, k in own))
                found.append([{"kind": k, "start": s, "end": e, "votes": "".join(map(str, votes(text, s, e, k)))} for s, e, k in [*own, *loose(text, own)]])
            n = np.array(counts, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, n), pa.array(base, pa.string()), pa.array(found, FOUND)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "found"])

    return arrow_map(keyed_documents(docs).select("doc_id", "text"), scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, found array<struct<kind: string, start: long, end: long, votes: string>>")


FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.string())]))


def reliabilities(patterns: list[tuple[str, str, int]], rounds: int = 50) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """Expectation-maximisation over counted vote patterns: the posterior of each pattern, each labeler's chances of
    its votes given true and false [labeler, truth, vote], and each kind's share of true ones. Each estimate starts
    from, and is drawn to, labelers that are right four times in five."""
    v = np.array([[int(c) for c in p] for _, p, _ in patterns])
    n = np.array([x for *_, x in patterns], float)
    kinds = sorted({k for k, *_ in patterns})
    of = np.array([kinds.index(k) for k, *_ in patterns])
    prior = np.zeros((v.shape[1], 2, 3))
    prior[:, 1] = 2, 6.4, 1.6  # abstains, yes, no
    prior[:, 0] = 2, 1.6, 6.4
    theta, share = prior / prior.sum(2, keepdims=True), np.full(len(kinds), 0.5)
    post = np.full(len(n), 0.5)
    for _ in range(rounds):
        logs = np.stack([np.log(theta[np.arange(v.shape[1]), t, v]).sum(1) for t in (0, 1)], 1)
        logs += np.log(np.stack([1 - share[of], share[of]], 1))
        post = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
        weight = np.stack([n * (1 - post), n * post], 1)
        made = prior.copy()
        for j in range(v.shape[1]):
            for t in (0, 1):
                made[j, t] += np.bincount(v[:, j], weight[:, t], 3)
        theta = made / made.sum(2, keepdims=True)
        share = (np.bincount(of, weight[:, 1], len(kinds)) + 2) / (np.bincount(of, n, len(kinds)) + 4)
    return post, theta, dict(zip(kinds, share.tolist(), strict=True))


def features(kind: str, p: str) -> np.ndarray:
    x = np.zeros(1 + 2 * len(p) + len(BASE) + len(MORE))
    x[0] = 1
    for i, c in enumerate(p):
        if c != "0":
            x[1 + 2 * i + int(c) - 1] = 1
    x[1 + 2 * len(p) + (*BASE, *MORE).index(kind)] = 1
    return x


def classifier(patterns: list[tuple[str, str, int]], post: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Logistic regression on votes and kind against the posteriors, by damped Newton steps."""
    x = np.stack([features(k, p) for k, p, _ in patterns])
    n = np.array([c for *_, c in patterns], float)
    n = n / n.sum() * max(len(n), 100)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + 0.05 * np.eye(len(w)), x.T @ (n * (post - p)) - 0.05 * w)
        w = w + np.clip(step, -2, 2)
    return w


def personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """candidates(), and spans: the fixed ones and those that the classifier gives at least `threshold`."""
    made = written(candidates(docs), "candidates")
    counted = made.select(F.explode("found").alias("x")).groupBy("x.kind", "x.votes").agg(F.count("*").alias("n")).collect()
    patterns = sorted((r["kind"], r["votes"], r["n"]) for r in counted)
    accepted = []
    if patterns:
        w = classifier(patterns, reliabilities(patterns)[0])
        accepted = [f"{k}:{p}" for k, p, _ in patterns if k in BASE or 1 / (1 + np.exp(-features(k, p) @ w)) >= threshold]
    keep = F.filter("found", lambda x: F.concat_ws(":", x["kind"], x["votes"]).isin(accepted)) if accepted else F.filter("found", lambda x: F.lit(False))
    order = F.array(*[F.lit(k) for k in (*BASE, *MORE)])
    spans = F.array_sort(F.transform(keep, lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["kind"]).alias("turn"), F.concat_ws(":", x["kind"], x["start"], x["end"]).alias("s"))))
    return made.withColumn("spans", F.array_join(F.transform(spans, lambda x: x["s"]), ","))


def op7(spark, sf_dir: str) -> DataFrame:
    from tesserae.llm.common import documents

    out = personal_data(documents(spark, sf_dir))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")

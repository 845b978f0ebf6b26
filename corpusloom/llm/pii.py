"""Personal data by fixed patterns and a skip-chain conditional random field.

The base patterns find e-mail addresses, IP addresses, cards and phone numbers. The
field then labels the tokens with digits or an at sign: neighbours in the text share
chain potentials, and repeated or similar tokens (a number and its endings, an address
and its variants), however far apart, share skip potentials with a hub of their entity,
which a base span of the same entity settles. Loopy message passing over these links
until it converges carries a label to the places where the entity appears in a form that
no pattern takes and that is no evidence by itself. Node, chain and skip weights are
trained together, by pseudo-likelihood on generated sentences in which such forms are
as often plain numbers, so they are the same for every table.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import hold_cache

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Messages pass until none changes by more than CLOSE. From round PATIENCE on, where loops
#: may swing, more of the old message is kept than the share DAMPING. ACCEPT: the
#: probability from which a token that no base span covers is taken.
CLOSE, PATIENCE, DAMPING, ACCEPT = 1e-4, 200, 0.3, 0.9

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits without three dotted followers has none from a later digit either.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ACTIVE = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_EDGE = ".,;:!?\"'<>[]{}"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each at sign: linear even in texts without spaces."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """(start, end) of the base matches of each kind, in code points."""
    ips = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    cards = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            cards.append(m.span())
    phones = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return [_emails(text), ips, cards, phones]


# -- the field ---------------------------------------------------------------

# Words before a token that speak for a kind.
CUES = {
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "cell", "dial"),
}
FEATURES = (
    "bias", "at", "at_dot", "ascii_local", "dots3", "octets", "digits_only", "digits<5", "digits5-8", "digits9-12", "digits13-19", "digits20+",
    "luhn", "letters", "bracketed3", "dashed", "3-4", "3-3-4", "4s", "plus", "after_plus", "after_bracketed3", "before_3-4", "few_dots", "slash_or_equals",
    "cue_email", "cue_ip", "cue_card", "cue_phone", "luhn_beside", "whole_phone",
)


def _features(words: list[str], i: int) -> list[int]:
    """The features (indices) of word i among its neighbours."""
    w = words[i].strip(_EDGE)
    prev = words[i - 1].strip(_EDGE) if i else ""
    before = words[i - 2].strip(_EDGE) if i > 1 else ""
    after = words[i + 1].strip(_EDGE) if i + 1 < len(words) else ""
    digits = "".join(c for c in w if c in "0123456789")
    n = len(digits)
    on = {
        "bias": True,
        "at": "@" in w,
        "at_dot": bool(re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", w)),
        "ascii_local": bool(re.match(r"[A-Za-z0-9._%+-]+@", w)),
        "dots3": bool(re.fullmatch(r"\d+\.\d+\.\d+\.\d+", w)),
        "octets": bool(re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", w)) and all(int(p) <= 255 for p in w.split(".")),
        "digits_only": bool(n) and w == digits,
        "digits<5": 0 < n < 5,
        "digits5-8": 5 <= n <= 8,
        "digits9-12": 9 <= n <= 12,
        "digits13-19": 13 <= n <= 19,
        "digits20+": n > 19,
        "luhn": 13 <= n <= 19 and w.replace("-", "") == digits and luhn(digits),
        "letters": any(c.isalpha() for c in w) and "@" not in w,
        "bracketed3": bool(re.fullmatch(r"\(\d{2,5}\)", w)),
        "dashed": "-" in w,
        "3-4": bool(re.fullmatch(r"\d{3}-\d{4}", w)),
        "3-3-4": bool(re.fullmatch(r"\(?\d{3}\)?[-.]\d{3}[-.]\d{4}", w)),
        "4s": bool(re.fullmatch(r"\d{4}(?:-\d{4}){2,3}", w)),
        "plus": w.startswith("+"),
        "after_plus": prev.startswith("+"),
        "after_bracketed3": bool(re.fullmatch(r"\(\d{2,5}\)", prev)),
        "before_3-4": bool(re.fullmatch(r"\d{3}-\d{4}", after)),
        "few_dots": 0 < w.count(".") < 3,
        "slash_or_equals": any(c in w for c in "/=:_"),
        **{f"cue_{k}": any(words[j].strip(_EDGE).lower().rstrip(":") in CUES[k] for j in range(max(0, i - 2), i)) for k in KINDS},
    }
    on["luhn_beside"] = on["luhn"] and (prev[-1:].isdigit() or after[:1].isdigit() or after[:1] == "+")
    plus, area = bool(re.fullmatch(r"\+\d{1,3}", w)), bool(re.fullmatch(r"\(\d{2,5}\)", after))
    on["whole_phone"] = plus and area or on["bracketed3"] and on["after_plus"] and on["before_3-4"] or on["3-4"] and on["after_bracketed3"] and before.startswith("+")
    return [j for j, f in enumerate(FEATURES) if on[f]]


def _key(word: str) -> str:
    """The name of the entity that a token may be a mention of; "" for none. An address goes
    by the part before the at sign without tag and separators, a number by its digits."""
    w = word.strip(_EDGE).lower()
    if "@" in w:
        local = re.sub(r"[._-]", "", w.split("@")[0].split("+")[0])
        return "@" + local if local else ""
    digits = "".join(c for c in w if c in "0123456789")
    if len(digits) >= 5 and not any(c.isalpha() for c in w):
        return "#" + digits
    plain = "".join(c for c in w if c.isalnum())
    return plain if len(plain) > 2 else ""


#: Digits from which a number's ending stands for the number.
ENDING = 7


def entities(keys: list[str]) -> dict[str, list[str]]:
    """The hubs of each key: its own name, or for a number the longest numbers among the
    keys that it is an ending of."""
    out = {k: [k] for k in keys}
    alike: dict[str, list[str]] = {}
    for k in out:
        if k[0] == "#" and len(k) > ENDING:
            alike.setdefault(k[-ENDING:], []).append(k)
    for group in alike.values():
        group.sort(key=lambda k: (-len(k), k))
        whole = {group[0][1:]: group[0]}
        ends = {group[0][-n:]: [group[0]] for n in range(ENDING, len(group[0]))}
        for k in group[1:]:
            if k[1:] in ends:
                out[k] = ends[k[1:]]
                continue
            whole[k[1:]] = k
            for n in range(ENDING, len(k)):
                ends.setdefault(k[-n:], []).append(k)
    return out


def _generated(count: int = 1500):
    """Documents with labelled tokens: [(words, labels, whether a base span covers them)].

    Entities are mentioned up to four times, in forms that the patterns take and in forms
    that they don't; the latter are as often numbers and names without a meaning. Cards and
    phones side by side are one match of a greedy pattern, which then drops them."""
    rng = np.random.default_rng(7)

    def d(n: int) -> str:
        return str(rng.integers(1, 10)) + "".join(map(str, rng.integers(0, 10, n - 1)))

    def name() -> str:
        return "".join(rng.choice(list("abdeilmnorst"), rng.integers(3, 8)))

    def phone():
        c, a, b, e = d(1), d(3), d(3), d(4)
        bare = [[a + b + e], [c + a + b + e], [f"{b}-{e}"], [f"{a}-{b}-{e}"], [f"{a}.{b}.{e}"], [b + e], [f"({a})", f"{b}-{e}"]]
        return [["+" + c, f"({a})", f"{b}-{e}"], ["+" + c + a + b + e], [f"+{c}-{a}-{b}-{e}"]], bare

    def card():
        body = d(15)
        n = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        g = [n[i : i + 4] for i in (0, 4, 8, 12)]
        return [[n], g, ["-".join(g)]], [[".".join(g)], ["/".join(g)], [n[-8:]]]

    def email():
        local, host = f"{name()}.{name()}" if rng.random() < 0.5 else name() + d(2), name()
        return [[f"{local}@{host}.example.com"], [f"{local}@{host}.org"]], [[f"{local}@{host}"], [f"{local}@"], [local.replace(".", "-") + "@" + host]]

    def ip():
        n = ".".join(str(rng.integers(1, 256)) for _ in range(4))
        return [[n], [n + ":" + d(4)]], [["ip-" + n.replace(".", "-")]]

    def plain() -> list[str]:
        kind = int(rng.integers(0, 9))
        return [
            lambda: d(int(rng.integers(1, 5))), lambda: f"{rng.integers(0, 30)}.{rng.integers(0, 20)}", lambda: f"{rng.integers(0, 9)}.{rng.integers(0, 9)}.{rng.integers(0, 9)}",
            lambda: "".join(rng.choice(list("abcdef0123456789"), int(rng.integers(12, 40)))) + "a1", lambda: "AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 15)) + "7",
            lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: f"(19{d(2)})", lambda: name() + d(2),
        ][kind]()

    out = []
    for _ in range(count):
        put: list[tuple] = []  # (form, kind, covered), or two of them side by side
        for _ in range(int(rng.integers(1, 4))):
            kind = KINDS[int(rng.integers(0, 4))]
            real = rng.random() < 0.5
            base, other = {"email": email, "ip": ip, "card": card, "phone": phone}[kind]()
            for n in range(int(rng.integers(1, 5))):
                if real and (n == 0 or rng.random() < 0.3):
                    put.append((base[int(rng.integers(0, len(base)))], kind, True))
                else:  # a number of the same form that is nobody's, or another mention
                    form = other[int(rng.integers(0, len(other)))]
                    cue = [str(rng.choice(CUES[kind]))] if rng.random() < (0.3 if real else 0.02) else []
                    put.append((cue + form, kind if real else "none", False))
        if rng.random() < 0.4:  # swallowed together
            for kind in rng.choice(["phone", "card", "card"], 2):
                form = (phone if kind == "phone" else card)()[0][0]
                put.append((form, str(kind), False))
            put[-2:] = [(put[-2], put[-1])]
        if rng.random() < 0.5:
            put.append(([d(16)], "none", False))
        put += [([plain()], "none", False) for _ in range(int(rng.integers(1, 5)))]
        words, labels, covered = [], [], []
        for i in rng.permutation(len(put)):
            rows = [(name(), 0, False) for _ in range(int(rng.integers(1, 4)))]
            for form, kind, base_form in put[i] if len(put[i]) == 2 else [put[i]]:
                rows += [(w, LABELS.index(kind) if _ACTIVE.search(w) else 0, base_form) for w in form]
            words += [w for w, _, _ in rows]
            labels += [y for _, y, _ in rows]
            covered += [c for _, _, c in rows]
        out.append((words, labels, covered))
    return out


#: Steps and length of a step of the training, and the weight of the squares of all weights.
STEPS, RATE, RIDGE = 400, 0.05, 1e-4


@lru_cache(maxsize=1)
def weights() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node weights, chain potentials, skip potentials), trained together.

    The pseudo-likelihood is the product of each label's probability given the features and
    the labels of all its neighbours: the tokens beside it and the hubs of its entity, and
    for a hub its mentions. A hub's label is the one most of its mentions have. Tokens that
    a base span covers are given, as they are when texts are labelled."""
    feats, ys, prev, after, hubs, own = [], [], [], [], [], []
    hub_seen, hub_y = [], []
    for words, labels, covered in _generated():
        active = [i for i, w in enumerate(words) if _ACTIVE.search(w)]
        keys = {i: k for i in active if (k := _key(words[i]))}
        spans: dict[str, int] = {}  # a base phone of several tokens is one number
        at = 0
        while at < len(words):
            end = at
            while covered[at] and end + 1 < len(words) and covered[end + 1] and labels[end + 1] == labels[at]:
                end += 1
            if covered[at]:
                spans[_key("".join(words[at : end + 1])) or "?"] = labels[at]
            at = end + 1
        names = entities([*dict.fromkeys([*keys.values(), *spans])])
        count: dict[str, np.ndarray] = {}
        for k, y in [*((keys[i], labels[i]) for i in active if i in keys), *spans.items()]:
            for h in names[k]:
                count.setdefault(h, np.zeros(5))[y] += 1
        for h, c in count.items():
            if c.sum() > 1:
                hub_seen.append(c)
                hub_y.append(int(c.argmax()))
        for i in active:
            if covered[i]:
                continue
            feats.append(_features(words, i))
            ys.append(labels[i])
            prev.append(labels[i - 1] if i and _ACTIVE.search(words[i - 1]) else 5)
            after.append(labels[i + 1] if i + 1 < len(words) and _ACTIVE.search(words[i + 1]) else 5)
            h = np.zeros(5)
            for x in names[keys[i]] if i in keys else ():
                rest = count[x].copy()
                rest[labels[i]] -= 1
                if rest.sum():
                    h[rest.argmax()] += 1
            hubs.append(h)
    x = np.zeros((len(feats), len(FEATURES)))
    for i, r in enumerate(feats):
        x[i, r] = 1
    hot = np.vstack([np.eye(5), np.zeros(5)])
    y, before, behind, near = np.eye(5)[ys], hot[prev], hot[after], np.array(hubs)
    hub_seen, hub_y = np.array(hub_seen), np.eye(5)[hub_y]
    hub_seen = hub_seen / hub_seen.sum(axis=1, keepdims=True)  # a hub weighs as its mentions do on average
    theta = [np.zeros((len(FEATURES), 5)), np.zeros((5, 5)), np.zeros((5, 5))]
    speed = [(np.zeros_like(t), np.zeros_like(t)) for t in theta]

    def softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    for step in range(1, STEPS + 1):
        w, chain, skip = theta
        gap = softmax(x @ w + before @ chain + behind @ chain.T + near @ skip) - y
        gap_hub = softmax(hub_seen @ skip.T) - hub_y
        grads = (x.T @ gap, before.T @ gap + gap.T @ behind, near.T @ gap + gap_hub.T @ hub_seen)
        for t, g, (m, v) in zip(theta, grads, speed, strict=True):
            g = g / len(x) + RIDGE * t
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            t -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[0], theta[1], theta[2]


def _marginals(total: np.ndarray) -> np.ndarray:
    out = np.exp(total - total.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def beliefs(node: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Marginals by loopy sum-product passing. node: (n, labels) log potentials; links, of
    each kind: (pairs (m, 2), log potentials [label of the first, label of the second]).
    Memory is in proportion to the links: two messages each."""
    links = [(p, psi) for p, psi in links if len(p)]
    if not links:
        return _marginals(node)
    pairs = np.concatenate([p for p, _ in links])
    n, cuts = len(pairs), np.cumsum([0, *(len(p) for p, _ in links)])
    a, b = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    message = np.zeros((2 * n, node.shape[1]))

    def totals() -> np.ndarray:
        total = node.copy()
        for y in range(node.shape[1]):
            total[:, y] += np.bincount(b, message[:, y], len(node))
        return total

    step, rounds, moved = 1 - DAMPING, 0, np.inf
    while moved > CLOSE:
        out = totals()[a] - message[np.r_[n : 2 * n, 0:n]]
        out -= out.max(axis=1, keepdims=True)
        new = np.empty_like(out)
        for (_, psi), lo, hi in zip(links, cuts[:-1], cuts[1:], strict=True):
            for side, m in ((slice(lo, hi), psi), (slice(n + lo, n + hi), psi.T)):
                new[side] = np.log(np.exp(out[side]) @ np.exp(m) + 1e-300)
        new -= new.max(axis=1, keepdims=True)
        moved = step * np.abs(new - message).max()
        message += step * (new - message)
        rounds += 1
        if rounds > PATIENCE:
            step *= 0.98
    return _marginals(totals())


def added_spans(text: str, base: list[list[tuple[int, int]]], model=None) -> list[list[tuple[int, int]]]:
    """Spans of each kind that the field adds to the base spans; none overlaps a base span."""
    w, chain, skip = model or weights()
    marks = [m.span() for m in _TOKEN.finditer(text)]
    active = [i for i, (a, b) in enumerate(marks) if _ACTIVE.search(text, a, b)]
    taken = sorted((a, b, k) for k, spans in enumerate(base, 1) for a, b in spans)
    node = np.zeros((len(active), 5))
    fixed = np.zeros(len(active), dtype=bool)
    at, beside, where = 0, [], -2
    mentions: dict[str, list[int]] = {}
    known: dict[str, np.ndarray] = {}
    for a, b, k in taken:
        if key := _key(text[a:b].replace(" ", "")):
            known.setdefault(key, np.zeros(5))[k] += 1
    for n, i in enumerate(active):
        a, b = marks[i]
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        k = next((k for x, y, k in taken[at : at + 8] if x < b and y > a), 0)
        if k:
            fixed[n] = True
            node[n] = -30.0
            node[n, k] = 0.0
        else:
            near = [text[x:y] for x, y in marks[max(0, i - 2) : i + 2]]
            node[n] = w[_features(near, min(i, 2))].sum(axis=0)
        if i - 1 == where:
            beside.append((n - 1, n))
        where = i
        if key := _key(text[a:b]):
            if not k:
                mentions.setdefault(key, []).append(n)
            elif key[0] != "#":  # the numbers of base spans are known whole
                known.setdefault(key, np.zeros(5))[k] += 1
    if fixed.all():
        return [[] for _ in KINDS]
    hubs: dict[str, list[int]] = {}
    names = entities([*mentions, *known])
    seen: dict[str, np.ndarray] = {}
    for key, c in known.items():
        for h in names[key]:
            seen[h] = seen.get(h, 0.0) + c
    for key, each in mentions.items():
        for h in names[key]:
            if h in seen:  # a hub whose label base spans give: evidence for each mention
                node[each] += np.log(seen[h] / seen[h].sum() @ np.exp(skip))
            else:
                hubs.setdefault(h, []).extend(each)
    many = [each for each in hubs.values() if len(each) > 1]
    spokes = [(len(active) + h, n) for h, each in enumerate(many) for n in each]
    pairs = [np.array(x, dtype=np.int64).reshape(-1, 2) for x in (beside, spokes)]
    p = beliefs(np.concatenate([node, np.zeros((len(many), 5))]), [(pairs[0], chain), (pairs[1], skip)])
    out: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    before = None
    for n, i in enumerate(active):
        k = int(p[n].argmax())
        if fixed[n] or not k or p[n, k] < ACCEPT:
            before = None
            continue
        raw = text[marks[i][0] : marks[i][1]]
        a = marks[i][0] + len(raw) - len(raw.lstrip(_EDGE))
        b = marks[i][1] - (len(raw) - len(raw.rstrip(_EDGE)))
        alone = raw.startswith("+") or sum(c.isdigit() for c in raw) >= 13  # begins an entity of its own
        if before == (i - 1, k) and not alone:
            out[k - 1][-1] = (out[k - 1][-1][0], b)
        else:
            out[k - 1].append((a, b))
        before = (i, k)
    return out


def _joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, s in zip(KINDS, spans, strict=True) for a, b in s)


def all_spans(text: str | None, model=None) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """(base, all): spans of each kind, sorted."""
    if not text or not _ACTIVE.search(text):
        none: list[list[tuple[int, int]]] = [[] for _ in KINDS]
        return none, none
    base = base_spans(text)
    return base, [sorted(b + m) for b, m in zip(base, added_spans(text, base, model), strict=True)]


def redact(text: str | None, model=None) -> str | None:
    """The text with each span replaced by <KIND>; overlapping spans become one."""
    if not text:
        return text
    spans = sorted((a, b, k) for k, s in zip(KINDS, all_spans(text, model)[1], strict=True) for a, b in s)
    if not spans:
        return text
    out, end = [], 0
    for a, b, k in spans:
        if a >= end:
            out += [text[end:a], f"<{k.upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def _find(model):
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        hold_cache(None)
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                rows = []
                for text in part.column("text").to_pylist():
                    base, spans = all_spans(text, model)
                    digest = hashlib.sha256(_joined(base).encode()).hexdigest() if any(base) else nothing
                    rows.append((*(len(s) for s in base), digest, _joined(spans)))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names)

    return run


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), a row for each row of `docs`.

    The counts and the digest are of the base spans; `spans` holds all of them. A null or
    empty text has none; a text of any length is one document to the field, whose memory is
    in proportion to its tokens with digits or an at sign. Repeated and null ids stay, ties
    between labels go to the earlier in LABELS, further columns, whatever their names, are
    ignored, and an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(_find(weights()), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _redact(text: int, model):
    def run(batches):
        hold_cache(None)
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                columns = part.columns
                columns[text] = pa.array([redact(t, model) for t in part.column(text).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return run


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the personal data in its texts replaced by <EMAIL>, <IP>, <CARD> or <PHONE>."""
    return docs.mapInArrow(_redact(docs.columns.index(text_col), weights()), docs.schema)

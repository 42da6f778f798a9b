"""Fixed values and string measures shared by the name operators."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

# Words that state a legal form and do not tell entities apart.
LEGAL_FORMS = frozenset(
    """
    inc incorporated corp corporation co company companies llc llp lp ltd limited plc ag sa na nv
    gmbh kg se spa srl bv ab oy as pty corpn coy cos incorp
    """.split()
)

# Usual abbreviations of business words and the word meant.
ABBREVIATIONS = {
    "bk": "bank", "bnk": "bank", "natl": "national", "nat": "national", "nationl": "national",
    "fin": "financial", "finl": "financial", "fncl": "financial", "grp": "group", "gp": "group",
    "sec": "securities", "secs": "securities", "intl": "international", "int": "international",
    "inv": "investments", "invt": "investments", "invts": "investments", "invs": "investments", "invest": "investments",
    "cap": "capital", "captl": "capital", "cptl": "capital", "mkt": "markets", "mkts": "markets", "mrkts": "markets",
    "cr": "credit", "crd": "credit", "crdt": "credit", "cred": "credit", "part": "partners", "ptrs": "partners", "prtnrs": "partners", "ptnrs": "partners",
    "tr": "trust", "trst": "trust", "bros": "brothers", "lndg": "lending", "lend": "lending",
    "eq": "equity", "eqty": "equity", "priv": "private", "pvt": "private", "pe": "pe", "mgmt": "management", "mgt": "management", "mgmnt": "management",
    "assoc": "associates", "assocs": "associates", "adv": "advisors", "advs": "advisors", "advrs": "advisors", "gr": "growth", "grth": "growth",
    "hldg": "holdings", "hldgs": "holdings", "hldngs": "holdings", "lgstcs": "logistics", "hold": "holdings", "inds": "industries", "ind": "industries",
    "sys": "systems", "syst": "systems", "svcs": "services", "svc": "services", "serv": "services", "srvcs": "services",
    "tech": "technologies", "techs": "technologies", "techn": "technologies",
    "sftwr": "software", "soft": "software", "diag": "diagnostics", "dx": "diagnostics", "tx": "therapeutics", "rx": "pharmaceuticals", "edu": "education", "educ": "education",
    "pharm": "pharmaceuticals", "pharma": "pharmaceuticals", "ins": "insurance", "insur": "insurance",
    "elec": "electronics", "semi": "semiconductors", "semis": "semiconductors", "telecomm": "telecom", "tel": "telecom",
    "util": "utilities", "transp": "transport", "log": "logistics", "mfg": "manufacturing",
}

# Short forms of given names and the full name.
NICKNAMES = {
    "al": "alexander", "alex": "alexander", "sandy": "alexander", "xander": "alexander", "andy": "andrew", "drew": "andrew",
    "tony": "anthony", "ben": "benjamin", "chuck": "charles", "charlie": "charles", "chris": "christopher", "kit": "christopher",
    "cathy": "catherine", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kay": "katherine",
    "dan": "daniel", "danny": "daniel", "dave": "david", "debbie": "deborah", "deb": "deborah", "debby": "deborah",
    "ed": "edward", "eddie": "edward", "ted": "edward", "ned": "edward", "teddy": "edward",
    "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "lizzie": "elizabeth", "libby": "elizabeth",
    "fred": "frederick", "greg": "gregory", "hank": "henry", "harry": "henry", "jim": "james", "jimmy": "james", "jamie": "james",
    "jen": "jennifer", "jenny": "jennifer", "jack": "john", "johnny": "john", "jon": "jonathan", "joe": "joseph", "joey": "joseph",
    "ken": "kenneth", "larry": "lawrence", "len": "leonard", "peggy": "margaret", "meg": "margaret", "maggie": "margaret", "marge": "margaret",
    "matt": "matthew", "mike": "michael", "mick": "michael", "mickey": "michael", "nat": "nathaniel", "nate": "nathaniel", "nathan": "nathaniel",
    "nick": "nicholas", "pat": "patricia", "patty": "patricia", "trish": "patricia", "tricia": "patricia", "pete": "peter", "phil": "philip",
    "becky": "rebecca", "becca": "rebecca", "rick": "richard", "dick": "richard", "rich": "richard", "ricky": "richard",
    "bob": "robert", "rob": "robert", "bobby": "robert", "robbie": "robert", "ron": "ronald", "sam": "samuel", "sammy": "samuel",
    "steve": "steven", "sue": "susannah", "susie": "susannah", "suzy": "susannah", "susan": "susannah", "anna": "susannah",
    "theo": "theodore", "tom": "thomas", "tommy": "thomas", "tim": "timothy", "vicky": "victoria", "will": "william", "bill": "william",
    "billy": "william", "liam": "william", "willie": "william",
}

TITLES = frozenset("mr ms mrs dr prof sir mr./ms.".split())

_MARK = re.compile(r"\(\s*the\s+[\"“”'‘’][^)]*\)|\(\s*\d+\s*\)|\[\s*\d+\s*\]|[*†‡§]+|\(\s*[a-z]\s*\)", re.IGNORECASE)
_TITLE = re.compile(r"^\s*(?:(?:mr|ms|mrs|dr|prof|sir)\b\.?\s*/?\s*)+(?=\S)", re.IGNORECASE)
_DOTTED = re.compile(r"\b((?:[a-z]\.){1,}[a-z])\.?(?![a-z])", re.IGNORECASE)
_SLASHED = re.compile(r"\b([a-z])/([a-z])\b", re.IGNORECASE)
_GLUED = re.compile(r"(?<=[a-z]{2})(?=[A-Z][a-z])")
_WORDS = re.compile(r"[a-z0-9&]+")


def fold(text: str) -> str:
    """Compatibility form without accents or zero-width marks."""
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


def name_tokens(name: str | None) -> list[str]:
    """Lower-case words of a name without accents, footnote marks, titles and a leading article.

    Dotted initials close up (``N.A.`` is ``na``), ``+`` and ``and`` become ``&``,
    capitals inside a word split it, and ``last, first`` order is turned round.
    """
    text = fold(name or "")
    text = _MARK.sub(" ", text)
    text = _TITLE.sub("", text)
    text = re.sub(r"'", "", text)
    text = text.replace("’", "").replace("+", " & ")
    text = _DOTTED.sub(lambda m: m.group(1).replace(".", ""), text)
    text = _GLUED.sub(" ", text)
    text = text.lower().strip()
    words = _WORDS.findall(text.replace("&", " & "))
    words = ["&" if w == "and" else w for w in words]
    if len(words) > 1 and words[0] == "the":
        words = words[1:]
    head, comma, tail = text.partition(",")
    if comma and tail.strip():
        last, first = _WORDS.findall(tail), _WORDS.findall(head)
        if last and first and not all(w.replace(".", "") in LEGAL_FORMS for w in last) and len(first) == 1:
            words = [*last, *first]
    return words


def strip_legal(words: list[str]) -> list[str]:
    """Words without legal forms at the end and ``& company`` anywhere; ``&`` left over at the end goes as well."""
    out: list[str] = []
    at = 0
    while at < len(words):
        if len(words) > 2 and words[at] == "&" and words[at + 1 : at + 2] in (["company"], ["co"]):
            at += 2
        else:
            out.append(words[at])
            at += 1
    out = out or list(words[:1])
    while len(out) > 1 and (out[-1] in LEGAL_FORMS or out[-1] == "&" or (len(out) > 2 and len(out[-1]) == 1)):
        out.pop()
    return out


def osa_within(a: str, b: str, limit: int) -> int:
    """Edit distance with adjacent swaps, or ``limit + 1`` once it is sure to be larger.

    Only the band of cells that can stay within the limit is computed.
    """
    n, m, far = len(a), len(b), limit + 1
    if abs(n - m) > limit:
        return far
    if a == b:
        return 0
    before: list[int] = []
    row = [min(j, far) for j in range(m + 1)]
    for i in range(1, n + 1):
        x = a[i - 1]
        nxt = [far] * (m + 1)
        if i <= limit:
            nxt[0] = i
        low = nxt[0]
        for j in range(max(1, i - limit), min(m, i + limit) + 1):
            y = b[j - 1]
            v = min(row[j] + 1, nxt[j - 1] + 1, row[j - 1] + (x != y), far)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and before[j - 2] + 1 < v:
                v = before[j - 2] + 1
            nxt[j] = v
            if v < low:
                low = v
        if low > limit and min(row) > limit:
            return far
        before, row = row, nxt
    return min(row[m], far)


def true_damerau(a: str, b: str) -> int:
    """Damerau-Levenshtein distance with free transpositions, a true metric."""
    seen: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2)] + [[far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        d.append([far, i] + [0] * len(b))
        match = 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), match
            cost = 1
            if x == y:
                cost, match = 0, j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        seen[x] = i
    return d[-1][-1]


def damerau_within(a: str, b: str, limit: int) -> int:
    """``true_damerau`` if it is at most ``limit``, else ``limit + 1``; only a band around the diagonal is computed."""
    far = limit + 1
    if abs(len(a) - len(b)) > limit:
        return far
    # rows[i][j] is the distance of the first i and j characters; a transposition reaches back limit rows at most.
    rows: dict[int, dict[int, int]] = {0: {j: j for j in range(limit + 1)}}
    for i in range(1, len(a) + 1):
        row: dict[int, int] = {0: i} if i <= limit else {}
        above = rows[i - 1]
        for j in range(max(1, i - limit), min(len(b), i + limit) + 1):
            v = min(above.get(j, far) + 1, row.get(j - 1, far) + 1, above.get(j - 1, far) + (a[i - 1] != b[j - 1]), far)
            for k in range(max(1, i - limit), i):
                if a[k - 1] != b[j - 1]:
                    continue
                for m in range(max(1, j - limit), j):
                    if b[m - 1] == a[i - 1]:
                        v = min(v, rows[k - 1].get(m - 1, far) + (i - k - 1) + 1 + (j - m - 1))
            row[j] = v
        rows[i] = row
        rows.pop(i - limit - 2, None)
    return min(rows[len(a)].get(len(b), far), far)


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in one matrix, padded with zeros, and their lengths."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.zeros((len(texts), int(lengths.max(initial=0))), dtype=np.uint32)
    for k, t in enumerate(texts):
        codes[k, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, lengths


#: Cells of distance tables that are filled side by side.
_CELLS = 2_000_000


def damerau_pairs(a: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """``true_damerau`` of each pair of coded texts, pairs of like length side by side."""
    out = np.zeros(len(a), dtype=np.int64)
    order = np.lexsort((b_len, a_len))
    start = 0
    while start < len(order):
        # The largest table of a run decides how many fit; lengths of a grow, those of b may not.
        size = max(1, _CELLS // ((int(a_len[order[start]]) + 5) * (int(b_len.max()) + 2)))
        part = order[start : start + size]
        part = part[a_len[part] <= a_len[part[0]] + 4]
        start += len(part)
        out[part] = _damerau_block(a[part], a_len[part], b[part], b_len[part])
    return out


def _damerau_block(a: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    count, n, m = len(a), int(a_len.max()), int(b_len.max())
    b = b[:, :m]
    far = n + m
    # table[:, i + 1, j + 1] is the distance of the first i and j characters; row and column 0 are out of reach.
    table = np.full((count, n + 2, m + 2), far, dtype=np.int16)
    table[:, 1, 1:] = np.arange(m + 1)
    column = np.arange(1, m + 1)
    seen = np.zeros((count, m), dtype=np.int64)  # last row whose character is that of each column
    pair = np.arange(count)[:, None]
    for i in range(1, n + 1):
        same = b == a[:, i - 1 : i]
        last = np.maximum.accumulate(np.where(same, column, 0), axis=1)
        last = np.concatenate([np.zeros((count, 1), dtype=last.dtype), last[:, :-1]], axis=1)
        swap = table[pair, seen, last] + (i - seen - 1) + 1 + (column - last - 1)
        best = np.minimum(np.minimum(table[:, i, 1:-1] + ~same, table[:, i, 2:] + 1), swap)
        # Insertions run along the row: the least of what stands left of a cell plus the way to it.
        line = np.concatenate([np.full((count, 1), i), best], axis=1) - np.arange(m + 1)
        table[:, i + 1, 1:] = np.minimum.accumulate(line, axis=1) + np.arange(m + 1)
        seen[same] = i
    return table[np.arange(count), a_len + 1, b_len + 1].astype(np.int64)

"""Brute-force references for the tests: a character scanner written from
the semantics (not from the Spark code), for small fixtures only."""

import re

LIT = re.compile(r"(?:'[^']*')+|\"[^\"]*\"")
WORD = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$#"
WS = " \t\n\x0b\f\r"


def strip_comments(s):
    out, i = [], 0
    while i < len(s):
        m = LIT.match(s, i)
        if m:
            out.append(m.group(0))
            i = m.end()
        elif s.startswith("--", i):
            j = i
            while j < len(s) and s[j] not in "\r\n":
                j += 1
            i = j
        elif s.startswith("/*", i) and s.find("*/", i + 2) >= 0:
            i = s.find("*/", i + 2) + 2
        else:
            out.append(s[i])
            i += 1
    return "".join(out)


def _is_select_at(s, j):
    return (s[j:j + 6].upper() == "SELECT" and (j == 0 or s[j - 1] not in WORD)
            and (j + 6 >= len(s) or s[j + 6] not in WORD))


def subqueries(text, section, sid):
    """-> (main, {n: content}, unbalanced). Post-order numbers per section."""
    spans, stack, n = [], [], 0
    i = 0
    while i < len(text):
        m = LIT.match(text, i)
        if m:
            i = m.end()
            continue
        c = text[i]
        if c == "(":
            j = i + 1
            while j < len(text) and text[j] in WS:
                j += 1
            stack.append((i, _is_select_at(text, j)))
        elif c == ")" and stack:
            o, is_sub = stack.pop()
            if is_sub:
                n += 1
                spans.append((o, i, n))
        i += 1
    if any(is_sub for _, is_sub in stack):
        return text, {}, True

    def render(lo, hi):  # text in [lo, hi) with direct child subqueries replaced
        kids = sorted((o, c, k) for o, c, k in spans if lo <= o and c < hi)
        out, pos = [], lo
        for o, c, k in kids:
            if o < pos:
                continue  # nested deeper: covered by its parent
            out.append(text[pos:o])
            out.append(f"(<<subquery_{section}[{sid}]_{k}>>)")
            pos = c + 1
        out.append(text[pos:hi])
        return "".join(out)

    subs = {k: render(o + 1, c) for o, c, k in spans}
    return render(0, len(text)), subs, False


def _word_at(s, i, w):
    n = len(w)
    return (s[i:i + n].upper() == w and (i == 0 or s[i - 1] not in WORD)
            and (i + n >= len(s) or s[i + n] not in WORD))


def columns(text):
    """-> (columns, star_content) for one log row's text."""
    q = text.strip(WS)
    i, depth, sel = 0, 0, None
    while i < len(q):
        m = LIT.match(q, i)
        if m:
            i = m.end()
            continue
        if depth == 0 and _word_at(q, i, "SELECT"):
            sel = i
            break
        depth += {"(": 1, ")": -1}.get(q[i], 0)
        i += 1
    if sel is None:
        return [], q
    cols, buf, i, depth, frm = [], [], sel + 6, 0, None
    while i < len(q):
        m = LIT.match(q, i)
        if m:
            buf.append(m.group(0))
            i = m.end()
            continue
        c = q[i]
        if depth == 0 and _word_at(q, i, "FROM"):
            frm = i
            break
        if depth == 0 and c == ",":
            cols.append("".join(buf))
            buf = []
        else:
            buf.append(c)
        depth += {"(": 1, ")": -1}.get(c, 0)
        i += 1
    cols.append("".join(buf))
    cols = [c.strip(WS) for c in cols if c.strip(WS)]
    star = (q[:sel] + "SELECT * " + (q[frm:] if frm is not None else "")).strip(WS)
    return cols, star


PIECES = re.compile(r"(?:'[^']*')+|\"[^\"]*\"|[^'\"]+|['\"]")
CODE_RULES = [(r"(?i)\bNVL\s*\(", "COALESCE("),
              (r"(?i)\bVARCHAR2\b(\s*\(\s*\d+\s*(?:BYTE|CHAR)?\s*\))?", "STRING"),
              (r"(?i)\bVARCHAR\b(?!\s*\()", "STRING"),
              (r"(?i)\bNUMBER\s*\(\s*(\d+)\s*(,\s*\d+\s*)?\)", lambda m: f"DECIMAL({m[1]}{m[2] or ''})"),
              (r"(?i)\bSYSDATE\b", "CURRENT_TIMESTAMP()")]


def convert(text):
    out = []
    for p in PIECES.findall(text):
        if p[0] in "'\"":
            out.append("'yyyyMMdd'" if p == "'YYYYMMDD'" else p)
        else:
            for pat, rep in CODE_RULES:
                p = re.sub(pat, rep, p)
            out.append(p)
    return "".join(out)


KINDS = ["UNION ALL", "UNION", "INTERSECT ALL", "INTERSECT", "EXCEPT ALL", "EXCEPT", "MINUS"]


def _pieces(text):
    """Characters outside quotes as (index, char); quoted parts as one item."""
    i = 0
    while i < len(text):
        m = re.compile(r"(?:'[^']*')+|\"[^\"]*\"").match(text, i)
        if m:
            yield i, m.group()
            i = m.end()
        else:
            yield i, text[i]
            i += 1


def sections(sql):
    """[(kind, content)] of a text, character by character."""
    text = strip_comments(sql)
    cuts, depth, end, state = [(0, "")], 0, 0, ""
    word = re.compile(r"(?i)(select|union(?:\s+all)?|intersect(?:\s+all)?|except(?:\s+all)?|minus)(?![A-Za-z0-9_$#])")
    for i, c in _pieces(text):
        if i < end or len(c) > 1 or c in "'\"":
            continue
        depth += (c == "(") - (c == ")")
        m = word.match(text, i)
        if m and depth == 0 and not (i and re.match(r"[A-Za-z0-9_$#]", text[i - 1])):
            kw = re.sub(r"\s+", " ", m.group().upper())
            cuts.append((i, kw))
            end = m.end()
            if kw != "SELECT":
                cuts.append((end, "after"))
    out = []
    for (a, kw), (b, _) in zip(cuts, cuts[1:] + [(len(text), "")]):
        body = text[a:b].strip(" \t\n\r\f\v")
        if not body:
            continue
        if a == 0 and not kw and re.match(r"(?i)with(?![A-Za-z0-9_$#])", body):
            out.append(("cte", body))
        elif re.match(r"(?i)[\s(]*select", body):
            out.append(("select", body))
        elif kw in KINDS:
            out.append(("join", re.sub(r"\s+", " ", body).upper()))
        else:
            out.append(("unknown", body))
    return out


def ctes(block):
    """[(name, body, named)] of a WITH block."""
    spans, depth, start, last = [], 0, 0, 0
    for i, c in _pieces(block):
        if c == "(":
            if depth == 0:
                start = i
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                spans.append((block[last:start], block[start + 1:i]))
                last = i + 1
    out = []
    for k, (lead, body) in enumerate(spans):
        head = re.search(r"(?i)(^|[^A-Za-z0-9_$#])as(\s+(not\s+)?materialized)?\s*$", lead)
        if not head:
            follows = k + 1 < len(spans) and re.match(r"(?i)\s*as(\s+(not\s+)?materialized)?\s*$", spans[k + 1][0])
            if not follows:
                out.append((None, body))
            continue
        name = lead[:head.start() + len(head.group(1))]
        if not name.strip() and k:
            name = spans[k - 1][0]
        m = re.search(r"(\"[^\"]+\"|[A-Za-z_][A-Za-z0-9_$#]*)\s*$", name)
        out.append((m.group(1) if m else None, body))
    return out

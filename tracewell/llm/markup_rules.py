"""Blocks of a text, the markup constructs in them, and their rendering as clean text.

``split_blocks`` cuts a text into leaf blocks (a heading, a list item, a run of prose lines, a
line inside a fence or element ...), each with its tag path: the stack of what is open around
it. With ``label`` it also says exactly of what kind each block is, and so whether it holds
something a renderer would format; that labels the labeller's training sample and nothing else.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Kinds of blocks; the first two are no markup.
KINDS = ("prose", "bare_code", "heading", "list", "code", "table", "formula", "quote", "inline", "element")
NO_MARKUP = 2

# Element, entity, command and environment names of the markup languages.
_TAGS = (
    "a abbr address article aside audio b blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em embed fieldset figcaption figure font footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark math meta nav nowiki noscript object ol optgroup option p param picture pre q ref references s samp "
    "script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr tt u ul var video gallery includeonly noinclude onlyinclude syntaxhighlight big"
)
_ATTR = r"""(?:\s+[\w:@.\-]+\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=]+)|\s+(?:disabled|checked|selected|async|defer|hidden|open|readonly|required|controls|nowrap|noshade|reversed))*"""
TAG = re.compile(rf"</?(?:{'|'.join(t for t in _TAGS.split() if len(t) > 1)}){_ATTR}\s*/?>|(?<![\w:<])<(?:[abipqsu]){_ATTR}\s*/?>|</[abipqsu]\s*>|<(?:[abipqsu])>(?=[^<>\n]*</[abipqsu]>)", re.I)
_NAMES = (
    "amp lt gt quot apos nbsp copy reg trade mdash ndash hellip laquo raquo lsquo rsquo ldquo rdquo bull middot times divide euro pound yen cent sect para deg plusmn frac12 frac14 frac34 "
    "auml ouml uuml Auml Ouml Uuml szlig eacute egrave agrave ccedil ntilde oacute iacute uacute aacute ecirc acirc ocirc larr rarr uarr darr harr alpha beta gamma delta lambda mu pi sigma omega infin le ge ne shy thinsp ensp emsp zwnj zwj"
)
ENTITY = re.compile(rf"&(?:{'|'.join(_NAMES.split())}|#\d{{2,6}}|#x[0-9a-fA-F]{{2,6}});")
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!doctype\b[^>]*>|<\?xml\b.*?\?>|<!\[CDATA\[", re.I | re.S)
_COMMANDS = (
    "begin end section subsection subsubsection paragraph chapter part emph textbf textit texttt textsc textrm textsf textsl underline cite citep citet ref eqref autoref pageref label footnote footnotemark caption "
    "href url item frac dfrac tfrac sqrt sum prod int lim infty alpha beta gamma delta epsilon lambda mu sigma omega theta phi pi leq geq neq le ge cdot cdots ldots dots times approx equiv "
    "in forall exists partial nabla mathbf mathrm mathcal mathbb mathit text left right quad qquad hspace vspace noindent newline newpage linebreak clearpage maketitle title author date documentclass usepackage "
    "includegraphics centering hline toprule midrule bottomrule multicolumn tableofcontents bibliography input include newcommand renewcommand verb lstinline tt bf em it LaTeX TeX textquote enquote par"
)
_BRACED = re.compile(rf"(?<![\\:/])\\(?:{'|'.join(_COMMANDS.split())})\*?(?=[\[{{])")
_SPACED = re.compile(r"(?<![\\\w:/])\\(?:item|hline|toprule|midrule|bottomrule|noindent|maketitle|tableofcontents|newpage|clearpage|centering|ldots|LaTeX|TeX|leq|geq|cdot|times|lambda|alpha|beta|gamma|infty|sum|frac|par|quad|qquad|linebreak|newline)(?![A-Za-z\\/.])")
_ESCAPED = re.compile(r"\d\\,\\?%?|(?<=[\w}])\\[%&](?=[\s.,;:)]|$)|(?<=\w)\\_(?=\w)|(?<![\\\w])\\[#{}](?=\s)|\w~\\\w|(?<=\S)\s*\\\\\s*$", re.M)
DISPLAY = re.compile(r"\\\[.+?\\\]|\\\(.+?\\\)|\$\$[^$]+?\$\$", re.S)
INLINE_MATH = re.compile(r"(?<![\\$\w])\$(?=[^\s$])(?P<m>[^$\n]{0,200}?[^\s$\\])\$(?![\w$])")
ENV = re.compile(r"^\s*\\(begin|end)\{([\w*]+)\}")

HEADING = re.compile(r"^ {0,3}(#{1,6})\s+(\S.*?)(?:\s+#+)?\s*$")
WIKI_HEADING = re.compile(r"^(={1,6}) ?(\S.*?\S|\S) ?\1\s*$")
JIRA_HEADING = re.compile(r"^h[1-6]\. +\S")
TEX_HEADING = re.compile(r"^\s*\\(?:(?:sub)*section|chapter|(?:sub)?paragraph|title|part)\*?(?:\[[^\]]*\])?\{")
SETEXT = re.compile(r"^ {0,3}(=+|-{3,})\s*$")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([\w+#.\-]*).*$")
RULE = re.compile(r"^ {0,3}(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$|^-{4,}$")
LIST = re.compile(r"^\s{0,6}(?:[-*+]\s+\S|\d{1,3}[.)]\s+\S|\*{2,4}\s*\S|#{1,4}\s+\S|[*#]+[:*#]+\s*\S)")
BULLET = re.compile(r"^\s{0,6}[-*+]\s+\S")
NUMBERED = re.compile(r"^\s{0,6}\d{1,3}[.)]\s+\S")
QUOTE = re.compile(r"^ {0,3}>\s?\S|^bq\. \S|^\{quote\}")
TABLE_RULE = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)*\|?\s*$")
PIPE_ROW = re.compile(r"^\s*\|.*\|\s*$")
JIRA_ROW = re.compile(r"^\s*\|\|.*\|\|\s*$")
WIKI_TABLE = re.compile(r"^\s*(?:\{\|(?:\s|$)|\|\}|\|-\s*|\|\+)")
JIRA_BLOCK = re.compile(r"\{(?:code|noformat|quote|panel|color|info|warning|tip|note)(?::[^}\n]{0,80})?\}")

_URL = r"(?:[a-z]+://|mailto:|\.{0,2}/|#|[\w\-]+(?:/|\.)[\w\-])"
IMAGE = re.compile(r"!\[[^\]\n]*\]\((?:\\.|[^()\n]|\([^()\n]*\))*\)|!\[[^\]\n]+\]\[[^\]\n]*\]")
LINK = re.compile(rf"(?<![\w!])\[(?:[^\[\]\n]|\[[^\]\n]*\])+\]\((?:<[^>\n]*>|{_URL}[^()\s]*(?:\([^()\s]*\)[^()\s]*)*|[\w\-]+)?(?:\s+(?:\"[^\"\n]*\"|'[^'\n]*'))?\)", re.I)
REF_LINK = re.compile(r"(?<![\w\])])\[[^\[\]\n]{1,120}\]\[[^\[\]\n]{0,80}\](?![\[\w])")
REF_DEF = re.compile(r"^ {0,3}\[[^\]\n]+\]:\s+\S+", re.M)
FOOTNOTE = re.compile(r"\[\^[\w\-]+\]")
TASK = re.compile(r"^\s*[-*+] \[[ xX]\] ", re.M)
STRONG = re.compile(r"(?<![\w*\\/])\*\*(?![\s*])[^*\n]{1,300}?(?<![\s*\\])\*\*(?![\w*])|(?<![\w_\\])__(?=[^\s_])[^_\n]*\s[^_\n]*(?<![\s_])__(?!\w)|(?<![\w*\\])\*\*\*(?!\s)[^*\n]+(?<!\s)\*\*\*(?![\w*])")
EMPH = re.compile(r"(?<![\w*\\/.\-])\*(?![\s*])[^*\n]{1,200}?(?<![\s*\\(])\*(?![\w*./])|(?<![\w\\/.\-$])_(?![\s_])[^_\n]{1,200}?(?<![\s_\\])_(?![\w(])")
STRIKE = re.compile(r"(?<![\w~])~~(?![\s~])[^~\n]+(?<!\s)~~(?![\w~])")
CODE_SPAN = re.compile(r"(?<![\\`\w])(`{1,2})(?!`)(?=\S)[^`\n]*[^`\n\s](?<!\\)\1(?![`\w])|(?<![\\`\w])`[^`\n\s]`(?![`\w])")
AUTOLINK = re.compile(r"<(?:https?|ftp|mailto)[:/][^\s<>]+>|<[\w.+\-]+@[\w\-]+\.[\w.\-]+>")
WIKI_LINK = re.compile(r"\[\[(?![\s\-\"'\d])(?:[^\[\]\n\"=<>]|\[[^\]\n]*\])+\]\]")
WIKI_EXT = re.compile(r"(?<![\w\]])\[https?://[^\s\]]+(?: [^\]\n]+)?\]")
TEMPLATE = re.compile(r"\{\{(?!\s*[{\"'])\s*[#:\w][^{}\n]*(?:\n[^{}]*)?\}\}")
WIKI_QUOTES = re.compile(r"(?<![\w'\"(=,])'{2,5}(?=[^\s'])[^'\n]+(?:'[^'\n]+)*(?<!\s)'{2,5}(?![\w'])")
WIKI_OTHER = re.compile(r"^#REDIRECT \[\[|__(?:NO)?TOC__|^:{1,4}\S.*|^;\s?\w[^:\n]*:", re.M)
INLINE_RULES = (IMAGE, LINK, REF_LINK, FOOTNOTE, STRONG, EMPH, STRIKE, CODE_SPAN, AUTOLINK, WIKI_LINK, WIKI_EXT, TEMPLATE, WIKI_QUOTES, TAG, ENTITY, COMMENT, DISPLAY, _BRACED, _SPACED, _ESCAPED, JIRA_BLOCK)

_CODE_LINE = re.compile(
    r"^\s*(?:(?:async )?def \w+\s*\(|class \w+\s*[:({]|(?:pub(?:\([^)]*\))? )?(?:async )?(?:fn|func|fun) \w|func \(|(?:export |async |default )*function\b\*? ?\w*\(|(?:export )?(?:const|let|var) [\w{\[]|local (?:function )?\w|"
    r"return\b(?! to )|import [\w{*\"']|from \S+ import|#include|package \w+;?$|using \w|if .*(?:[:{]|\bthen)\s*$|if .*\bthen\b.*\bend\s*$|if \(|if not \w+:|elif |else\s*[:{]?\s*$|for .*(?:[:{]|\bdo)\s*$|while .*(?:[:{]|\bdo)\s*$|end\s*$|done\s*$|fi\s*$|do\s*$|esac\s*$|"
    r"(?:public|private|protected|static|final) [\w<]|[})\]]+[;,)]*(?: \w+)*\s*[{;]?\s*$|\w+\(\)\s*\{|\) ?->.*[:{]\s*$|[\w.\[\]$\"']+(?:\[[^\]]*\])? ?(?:[-+*/|&]?=|:=|<<|\+=) ?\S.*|[\w.]+\([^)]*\);?\s*$|@\w+(?:[.(].*)?$|"
    r"\[ -\w |printf |echo |  +\w+ \"\$|\w+ \"\$\w+\"|\w+: (?:int|str|dict|list|float|bool)\b.*,?\s*$|\w+,\s*$|log\.\w+\(|raise \w+|try\s*[:{]|except\b.*:$|catch\b.*[{]$|\w+ = (?:\"\"\"|''')|(?:select|SELECT) .* (?:from|FROM) |(?:insert into|INSERT INTO) |(?:create|CREATE) (?:table|view|TABLE|VIEW) |.*;\s*$|\w+ << |\w+\.each do)",
)
_COMMENT_LINE = re.compile(r"^\s*(?:#(?!#)|//|--(?!-)|/\*|\*(?:\s|/|$))")
_OPENERS = re.compile(r"^\s*(?:\"\"\"|'''|r\"\"\"|[rRuU]?\"\"\"|/\*\*?)")


@dataclass
class Block:
    start: int
    end: int
    path: tuple[str, ...]
    text: str
    kind: int = 0


def bare_code_lines(lines: list[str]) -> list[bool]:
    """Lines of code that stand in the text without any markup around them, their comments and docstrings included."""
    n = len(lines)
    code = [bool(s.strip()) and bool(_CODE_LINE.match(s)) and not (s.rstrip().endswith(";") and ENTITY.search(s)) for s in lines]
    # Runs of code carry: what lies between quotes or comment signs near code is code.
    i = 0
    while i < n:
        s = lines[i].strip()
        q = '"""' if '"""' in s else "'''" if "'''" in s else ""
        if q and s.count(q) == 1 and re.match(r"[rRuU]?(?:\"\"\"|''')", s):
            j = next((k for k in range(i + 1, n) if q in lines[k]), -1)
            if j > 0 and (any(code[max(0, i - 3) : i]) or j + 1 < n and any(code[j + 1 : j + 3])):
                for k in range(i, j + 1):
                    code[k] = True
                i = j
        elif q and re.match(r"[rRuU]?(?:\"\"\"|''')", s) and i and (code[i - 1] or not lines[i - 1].strip() and i > 1 and code[i - 2]):
            code[i] = True
        elif s.startswith("/*"):
            j = next((k for k in range(i, n) if "*/" in lines[k]), n - 1)
            for k in range(i, j + 1):
                code[k] = True
            i = j
        i += 1
    for _ in range(2):
        for order in (range(n), range(n - 1, -1, -1)):
            for k in order:
                s = lines[k]
                if code[k] or not s.strip():
                    continue
                near = [lines_k for lines_k in (k - 1, k + 1) if 0 <= lines_k < n and lines[lines_k].strip()]
                if _COMMENT_LINE.match(s) and any(code[x] for x in near) or (s.startswith(("  ", "\t")) and near and all(code[x] for x in near) and not LIST.match(s)):
                    code[k] = True
    return code


def inline_construct(text: str) -> bool:
    if any(rx.search(text) for rx in INLINE_RULES):
        return True
    for m in INLINE_MATH.finditer(text):
        body = m["m"]
        if re.search(r"[\\^{}]|_\w|[=<>+]", body) and not re.search(r"\"|\b(?:and|the|or|to)\b", body) or re.fullmatch(r"[A-Za-z](?:\([\w, ]+\))?'?", body):
            return True
    return False


def split_blocks(text: str, label: bool = True) -> list[Block]:
    """Leaf blocks in order, with path and, if wanted, exact kind (else the kind is that of the cut and says nothing of what stands inside)."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    bare = bare_code_lines(lines)
    blocks: list[Block] = []
    path: list[str] = []
    i, n = 0, len(lines)

    def add(a: int, b: int, kind: str, *extra: str) -> None:
        blocks.append(Block(a, b, (*path, *extra), "\n".join(lines[a:b]), KINDS.index(kind)))

    while i < n:
        s = lines[i]
        t = s.strip()
        if not t:
            i += 1
            continue
        f = FENCE.match(s)
        if f and "`" not in s.strip()[len(f[1]) :]:
            j = next((k for k in range(i + 1, n) if re.match(rf"^ {{0,3}}{re.escape(f[1][0])}{{{len(f[1])},}}\s*$", lines[k])), n - 1)
            add(i, j + 1, "code", "fence")
            i = j + 1
            continue
        m = JIRA_BLOCK.match(t)
        if m and m[0].startswith(("{code", "{noformat")) and t.count("{") == 1:
            close = re.match(r"\{\w+", m[0])[0] + "}"
            j = next((k for k in range(i + 1, n) if close in lines[k]), n - 1)
            add(i, j + 1, "code", "macro")
            i = j + 1
            continue
        e = ENV.match(s)
        if e and e[1] == "begin":
            name = e[2].rstrip("*")
            if name in ("verbatim", "lstlisting", "minted", "equation", "align", "gather", "math", "displaymath", "tabular"):
                j = next((k for k in range(i, n) if f"\\end{{{e[2]}}}" in lines[k]), n - 1)
                add(i, j + 1, "code" if name in ("verbatim", "lstlisting", "minted") else "table" if name == "tabular" else "formula", name)
                i = j + 1
                continue
            add(i, i + 1, "element", name)
            path.append(name)
            i += 1
            continue
        if e:
            add(i, i + 1, "element")
            if path and path[-1] == e[2].rstrip("*"):
                path.pop()
            i += 1
            continue
        if re.search(r"<pre\b|<script\b|<style\b|<syntaxhighlight\b", t, re.I):
            name = re.search(r"<(pre|script|style|syntaxhighlight)\b", t, re.I)[1].lower()
            j = next((k for k in range(i, n) if f"</{name}" in lines[k].lower()), None)
            if j is not None:
                add(i, j + 1, "code" if name in ("pre", "syntaxhighlight") else "element", name)
                i = j + 1
                continue
        if t.startswith("<!--"):
            j = next((k for k in range(i, n) if "-->" in lines[k]), n - 1)
            add(i, j + 1, "element", "comment")
            i = j + 1
            continue
        if t.startswith("{|"):
            j = next((k for k in range(i, n) if lines[k].strip().startswith("|}")), n - 1)
            add(i, j + 1, "table", "wikitable")
            i = j + 1
            continue
        if bare[i]:
            j = i
            while j < n and (bare[j] or not lines[j].strip() and j + 1 < n and bare[j + 1]):
                j += 1
            add(i, j, "bare_code")
            i = j
            continue
        nxt = lines[i + 1] if i + 1 < n else ""
        before = lines[i - 1].strip() if i else ""
        wiki_list = bool(re.match(r"^[*#]{1,4}[ :]?\s*\S", s)) and bool(re.match(r"^[*#]{1,4} ", nxt) or re.match(r"^[*#]{1,4} ", before))
        if HEADING.match(s) and not (wiki_list and HEADING.match(s)[1] in ("#", "##") and (HEADING.match(nxt) or HEADING.match(before))):
            add(i, i + 1, "heading", "h")
        elif WIKI_HEADING.match(t) and not SETEXT.match(s) or JIRA_HEADING.match(t) or TEX_HEADING.match(s):
            add(i, i + 1, "heading", "h")
        elif nxt and SETEXT.match(nxt) and not PIPE_ROW.match(s) and not TABLE_RULE.match(s) and len(t) < 120 and (not before or i == 0) and not RULE.match(s):
            add(i, i + 2, "heading", "h")
            i += 2
            continue
        elif JIRA_ROW.match(s) or PIPE_ROW.match(s) and (PIPE_ROW.match(nxt) or TABLE_RULE.match(nxt) or PIPE_ROW.match(before) or JIRA_ROW.match(before)) or ("|" in s and TABLE_RULE.match(nxt) and "|" in nxt):
            j = i
            while j < n and "|" in lines[j] and lines[j].strip():
                j += 1
            add(i, j, "table", "table")
            i = j
            continue
        elif WIKI_TABLE.match(s) and t != "|":
            add(i, i + 1, "table", "wikitable")
        elif RULE.match(s):
            add(i, i + 1, "element", "hr") if len(t.replace(" ", "")) <= 80 else add(i, i + 1, "prose")
        elif QUOTE.match(s):
            j = i
            while j < n and QUOTE.match(lines[j]):
                j += 1
            add(i, j, "quote", "quote")
            i = j
            continue
        elif TASK.match(s) or wiki_list or BULLET.match(s) or NUMBERED.match(s) and (NUMBERED.match(nxt) or NUMBERED.match(before)) or t.startswith("\\item"):
            add(i, i + 1, "list", "li")
        elif REF_DEF.match(s):
            add(i, i + 1, "element", "ref")
        elif re.match(r"^(?:\\\[.*\\\]|\$\$.*\$\$)$", t):
            add(i, i + 1, "formula", "display")
        elif t.startswith("<") and TAG.match(t):
            tag = re.match(r"</?(\w+)", t)[1].lower()
            kind = "heading" if re.fullmatch(r"h[1-6]|title", tag) else "list" if tag in ("li", "ul", "ol", "dl", "dt", "dd") else "table" if tag in ("table", "tr", "td", "th", "thead", "tbody") else "quote" if tag == "blockquote" else "code" if tag == "code" else "element"
            add(i, i + 1, kind, tag)
            if tag in ("ul", "ol", "div", "section", "table", "body", "html", "dl", "article", "blockquote", "nav", "main") and not t.startswith("</") and f"</{tag}" not in t.lower():
                path.append(tag)
            elif t.startswith("</") and path and path[-1] == tag:
                path.pop()
        else:
            j = i + 1
            while j < n and lines[j].strip() and not bare[j] and not (HEADING.match(lines[j]) or FENCE.match(lines[j]) or BULLET.match(lines[j]) or QUOTE.match(lines[j]) or PIPE_ROW.match(lines[j]) or ENV.match(lines[j]) or lines[j].lstrip().startswith("<") and TAG.match(lines[j].lstrip()) or lines[j].strip().startswith(("{|", "\\item", "<!--")) or WIKI_HEADING.match(lines[j].strip()) or TEX_HEADING.match(lines[j]) or (j + 1 < n and SETEXT.match(lines[j + 1]) and not lines[j - 1].strip())):
                j += 1
            body = "\n".join(lines[i:j])
            kind = "prose" if not label else "formula" if re.fullmatch(r"\s*(?:\\\[.*\\\]|\$\$.*\$\$)\s*", body, re.S) else "inline" if inline_construct(body) or WIKI_OTHER.search(body) and not re.search(r"^:\w+:", body) and re.match(r"^[:;#_]", body) else "prose"
            add(i, j, kind)
            i = j
            continue
        i += 1
    return blocks


def has_markup(blocks: list[Block]) -> bool:
    return any(b.kind >= NO_MARKUP for b in blocks)


def _strip_inline(s: str) -> str:
    s = COMMENT.sub("", s)
    s = re.sub(r"<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref>", "", s, flags=re.I | re.S)
    s = re.sub(r"<br\s*/?>", "\n", s, flags=re.I)
    s = re.sub(r"<(?:code|tt|kbd|samp)\b[^>]*>(.*?)</(?:code|tt|kbd|samp)>", r"`\1`", s, flags=re.I | re.S)
    s = re.sub(r"<(?:math)\b[^>]*>(.*?)</math>", r"$\1$", s, flags=re.I | re.S)
    s = TAG.sub("", s)
    s = IMAGE.sub(lambda m: re.match(r"!\[([^\]]*)\]", m[0])[1], s)
    s = LINK.sub(lambda m: m[0][1 : m[0].rindex("](")], s)
    s = REF_LINK.sub(lambda m: m[0][1 : m[0].index("]")], s)
    s = FOOTNOTE.sub("", s)
    s = WIKI_LINK.sub(lambda m: "" if re.match(r"\[\[(?:Category|File|Image):", m[0], re.I) else m[0][2:-2].split("|")[-1], s)
    s = WIKI_EXT.sub(lambda m: m[0][1:-1].split(" ", 1)[-1], s)
    s = TEMPLATE.sub(lambda m: m[0][2:-2].split("|")[-1].strip(), s)
    s = re.sub(r"'{2,5}(?=\S)(.+?)(?<=\S)'{2,5}", r"\1", s)
    s = STRONG.sub(lambda m: m[0].strip("*_"), s)
    s = EMPH.sub(lambda m: m[0][1:-1], s)
    s = STRIKE.sub(lambda m: m[0][2:-2], s)
    s = re.sub(r"\{(?:noformat|code|quote|color|panel|info|tip|note|warning)(?::[^}]*)?\}", "", s)
    s = re.sub(r"\\\((.+?)\\\)", r"$\1$", s, flags=re.S)
    math = []

    def keep(m: re.Match) -> str:
        math.append(m[0])
        return f"\0{len(math) - 1}\0"

    s = re.sub(r"\\\[.+?\\\]|\$\$[^$]+\$\$", keep, s, flags=re.S)
    s = INLINE_MATH.sub(keep, s)
    s = re.sub(r"~?\\(?:cite|citep|citet|ref|eqref|autoref|pageref|label|footnotemark)\*?(?:\[[^\]]*\])*\{[^{}]*\}", "", s)
    s = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", s)
    for _ in range(3):
        s = re.sub(r"\\(?:emph|text\w\w|underline|enquote|footnote|caption|url|mbox|title|author|date)\*?\{([^{}]*)\}", r"\1", s)
    s = re.sub(r"\\([%&_#${}])", r"\1", s).replace("\\,", " ")
    s = re.sub(r"\\(?:noindent|centering|maketitle|newpage|clearpage|hline|quad|qquad|par|tableofcontents)\b\s?", "", s)
    s = re.sub(r"\\ldots\b|\\dots\b", "…", s)
    s = re.sub("\0(\\d+)\0", lambda m: math[int(m[1])], s)
    return html.unescape(s)


def _cells(row: str) -> str:
    cells = [_strip_inline(c).strip() for c in re.split(r"\|\|?|!!", row.strip().strip("|!"))]
    return " | ".join(c for c in cells)


def render(block: Block) -> str:
    """A block as clean text: headings ``# x``, lists ``- x``, code fenced, tables with ``|``, formulas between dollars."""
    kind, t = KINDS[block.kind], block.text
    if kind in ("prose", "bare_code"):
        return t
    if kind == "heading":
        first = t.split("\n")[0].strip()
        for rx, level in ((HEADING, lambda m: len(m[1])), (WIKI_HEADING, lambda m: len(m[1]))):
            if m := rx.match(first):
                return "#" * level(m) + " " + _strip_inline(m[2]).strip()
        if m := re.match(r"<h([1-6])\b", first, re.I):
            return "#" * int(m[1]) + " " + _strip_inline(first).strip()
        if m := re.match(r"h([1-6])\. +(.*)", first):
            return "#" * int(m[1]) + " " + _strip_inline(m[2]).strip()
        if m := re.match(r"\\((?:sub)*)(?:section|paragraph|chapter|title|part)\*?(?:\[[^\]]*\])?\{([^{}]*)\}", first):
            return "#" * (1 + m[1].count("sub")) + " " + _strip_inline(m[2]).strip()
        return "# " + _strip_inline(first).strip()
    if kind == "list":
        if re.match(r"\s*</?(?:ul|ol|dl)\s*>\s*$", t, re.I):
            return ""
        items = re.split(r"<li\b[^>]*>|<d[td]\b[^>]*>", t, flags=re.I)[1:] if "<" in t and re.search(r"<(?:li|dt|dd)\b", t, re.I) else [re.sub(r"^\s*(?:[-*+#:]+\s*|\d+[.)]\s+|\\item\s*)(?:\[[ xX]\]\s*)?", "", t)]
        return "\n".join("- " + x for x in (_strip_inline(i).strip() for i in items) if x)
    if kind == "code":
        lines = t.split("\n")
        if FENCE.match(lines[0]):
            closed = len(lines) > 1 and FENCE.match(lines[-1])
            body = "\n".join(lines[1 : -1 if closed else None])
        else:
            body = re.sub(r"^\s*(?:\{(?:code|noformat)[^}]*\}|\\begin\{\w+\}(?:\[[^\]]*\])?)\n?|\n?(?:\{(?:code|noformat)\}|\\end\{\w+\})\s*$", "", t)
            if re.search(r"<(?:pre|code)\b", body, re.I):
                body = html.unescape(TAG.sub("", body))
        return "```\n" + body.strip("\n") + "\n```"
    if kind == "table":
        if re.search(r"<t[rhd]\b", t, re.I):
            rows = [[_strip_inline(c).strip() for c in re.split(r"<t[hd]\b[^>]*>", r, flags=re.I)[1:]] for r in re.split(r"<tr\b[^>]*>", t, flags=re.I)[1:]]
            return "\n".join(" | ".join(r) for r in rows if r)
        if "\\begin{tabular}" in t:
            body = re.sub(r"\\(?:begin|end)\{tabular\}(?:\{[^{}]*\})?|\\hline", "", t)
            return "\n".join(" | ".join(_strip_inline(c).strip() for c in r.split("&")) for r in body.split("\\\\") if r.strip())
        rows = [r for r in t.split("\n") if r.strip() and not TABLE_RULE.match(r) and not re.match(r"^\s*(?:\{\||\|\}|\|-|\|\+)", r)]
        return "\n".join(_cells(r) for r in rows)
    if kind == "formula":
        body = re.sub(r"^\s*(?:\\\[|\$\$|\\begin\{[\w*]+\})|(?:\\\]|\$\$|\\end\{[\w*]+\})\s*$", "", t).strip()
        return "$$" + body + "$$"
    if kind == "quote":
        return _strip_inline("\n".join(re.sub(r"^\s*(?:>\s?|bq\. )", "", x) for x in t.split("\n")))
    if kind == "element" and (block.path[-1:] in (("script",), ("style",), ("comment",), ("hr",), ("ref",)) or ENV.match(t)):
        return ""
    return _strip_inline(t).strip() if kind == "element" else _strip_inline(t)


def clean(blocks: list[Block]) -> str:
    parts = [(b, render(b)) for b in blocks]
    out, last = [], None
    for b, r in parts:
        if not r:
            continue
        tight = last is not None and KINDS[b.kind] == KINDS[last.kind] == "list"
        if out:
            out.append("\n" if tight else "\n\n")
        out.append(r)
        last = b
    return "".join(out)

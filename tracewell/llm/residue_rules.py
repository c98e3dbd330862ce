"""What template residue looks like in prose, and what only talks about it.

``read`` cuts a text into the passages of its prose (fences, code, quoted parts and reported
speech taken out). An open value, dummy Latin, mashed keys or an error payload show themselves
wherever they stand. Sentences of filler, error pages and script notices are only trusted where
they stand in place of content: in a text of few distinct passages. Elsewhere the rules aren't
asked; such a passage is named by its likeness to a trusted one.
"""

from __future__ import annotations

import re
from re import _parser

# The syntaxes in which template engines and forms leave a value open.
_ID = r"[A-Za-z][\w .\-]{0,60}"
PLACEHOLDER = re.compile(
    "|".join(
        (
            r"\{\{\{?\s*[#/^&>]?\s*[A-Za-z_][\w .|\-]{0,60}\s*\}?\}\}",
            r"\{%\s*[A-Za-z_][\w .|\-]{0,60}\s*%\}",
            r"<%[=\-]?\s*[A-Za-z_@][\w .|\-]{0,60}\s*-?%>",
            r"\$\{\s*[A-Za-z_][\w.\-]{0,60}\s*\}",
            r"\$\([A-Z][A-Z0-9_]{1,60}\)",
            r"#\{\s*[A-Za-z_@][\w.]{0,60}\s*\}",
            r"%\([A-Za-z_]\w{0,60}\)[sdifr]\b",
            r"(?<![\w%])%[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+%(?!\w)",
            r"(?<![\w#])#[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+#(?!\w)",
            r"@@[A-Za-z]\w{1,60}@@",
            r"(?<!\w)__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+__(?!\w)",
            r"\[\[\s*[A-Za-z_][\w.\-]{0,60}\s*\]\]",
            r"\(\(\s*[A-Za-z]+(?:_\w+)+\s*\)\)",
            r"«\s*[A-Za-z]+(?:_\w+)*\s*»",
            r"(?<![\w{$#/]){\d}(?![\w}])",
            rf"<(?:YOUR|INSERT|ENTER|ADD|FILL|PUT|TODO)[_ :\-]{_ID}>",
            rf"<(?:your|insert|enter|add|fill in|put|todo)[_ :\-]{_ID}>",
            rf"\[(?:your|insert|enter|add|fill in|put|todo|tbd)\b[: _\-]*{_ID}\]",
            rf"\[(?:Your|Insert|Enter|Add|Fill in|Put|Todo|TODO|TBD|YOUR|INSERT|ENTER|FILL IN)\b[: _\-]*{_ID}\]",
            rf"\[{_ID} (?:goes|comes|belongs) here\]",
            r"\[object Object\]",
        )
    )
)
# Words of dummy Latin; a sentence mostly made of such words and unknown ones is filler.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint "
    "occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum urna nullam quorum vestibulum mauris pellentesque".split()
)
FILLER = re.compile(
    "|".join(
        (
            r"\blorem ipsum\b",
            r"^(?:foo[ ,]+bar[ ,]+(?:and )?baz|(?:bla+h?[ ,]*){2,}|(?:text[ ,]*){3,}|(?:test[ ,]*){3,}|(?:asdf|qwerty)[ ,.]*)[.!…]*$",
            r"\b(?:sample|dummy|placeholder|filler|example|some|body) (?:text|copy|content)(?: (?:goes |comes |belongs )?here)?\s*[.!…]*$",
            r"\b(?:your|some|body|the|main|page) ?(?:own )?(?:content|text|copy|description|title|summary|paragraph)s? (?:goes|go|comes|belongs|will be|will go) here\b",
            r"\bthis is (?:a )?(?:placeholder|dummy|sample|filler|blind)\b",
            r"\breplace this (?:paragraph|text|section|line|sentence|page|placeholder)\b",
            r"\b(?:delete|remove) this (?:line|paragraph|text|section|note)\b",
            r"^(?:[-*#>]\s*)?(?:write|add|put|describe|insert|enter) (?:a |an |your |one |two |three |here )(?:or (?:two|three) )?[\w ]{0,30}(?:sentences?|summary|description|paragraphs?|introduction|title|text)\b[^.]{0,40}(?:here|about what this|what this does)",
            r"^(?:section|chapter|page|paragraph|heading|title|item) (?:intro|body|title|text|one|two|three|first|second)\.?$",
            r"\bblindtext\b",
            r"\bhier (?:steht|folgt|kommt) (?:später|noch|bald)\b.*\btext\b",
            r"\btext(?:e|o)? (?:provisoire|factice|de remplissage|de ejemplo|de relleno|provisional)\b",
            r"ここに.{0,12}(?:入ります|入れて|書いて|入力)|(?:ダミー|サンプル|仮の)テキスト|ダミー文",
            r"此处.{0,10}(?:填写|输入|填入|添加)|(?:示例|占位|测试)(?:文本|文字|内容)|在此(?:输入|填写|处)",
            r"здесь (?:будет|должен быть|появится).{0,30}(?:текст|описание)|(?:текст-заполнитель|рыбный текст|пример текста|текст[- ]рыба)",
        )
    ),
    re.I,
)
SCRIPTS = re.compile(
    "|".join(
        (
            r"\b(?:enable|allow|activate|permit|switch on|turn on)\b[^.]{0,25}\b(?:java ?script|js|scripts?|scripting|cookies|client-side code)\b",
            r"\b(?:java ?script|js|scripts?|scripting|cookies|client-side code)\b[^.]{0,40}\b(?:(?:is|are) (?:turned off|switched off|disabled|blocked|required|needed|not (?:enabled|allowed|available))|must be (?:on|enabled|allowed|switched on|turned on)|to (?:run|work|view|continue))\b",
            r"\b(?:does not|doesn't|doesn’t|will not|won't|won’t|cannot|can't|can’t) (?:work|run|load|be (?:shown|displayed|used))\b[^.]{0,20}\bwithout (?:java ?script|js|scripts?|scripting|cookies|client-side code)\b",
            r"\b(?:works?|runs?|usable|available) only with\b[^.]{0,15}\b(?:java ?script|js|scripts?|scripting|cookies|client-side code)\b",
            r"\b(?:needs?|requires?) (?:java ?script|js|scripts|scripting|cookies|client-side code)\b",
            r"\byour browser (?:may be|is|might be) (?:blocking|not running|refusing) (?:scripts?|java ?script|js|cookies|client-side code|scripting)\b",
            r"^<?noscript>?\b",
            r"\bunsupported browser\b",
            r"\byour browser is (?:checked|being checked|verified|tested) before\b|\bchecking your browser\b",
            r"\bactive[zr] (?:java ?script|les cookies|js)\b|\bactivar (?:java ?script|las cookies|js)\b|\bhabilit(?:e|ar) (?:java ?script|las cookies|js)\b",
            r"\bjava ?script (?:ist|wurde) (?:abgeschaltet|deaktiviert|ausgeschaltet)\b|\bjava ?script (?:aktivieren|einschalten|erlauben)\b|\bbitte (?:aktivieren|schalten) sie (?:java ?script|cookies)\b",
            r"включите (?:java ?script|cookies|скрипты)|java ?script (?:отключ|выключ)|для работы .{0,30}java ?script",
            r"java ?script ?を(?:有効|オン)|java ?script ?が(?:無効|オフ)",
            r"(?:启用|开启|打开|允许)(?: ?java ?script|脚本)|java ?script ?(?:已|被)?(?:禁用|关闭)",
        )
    ),
    re.I,
)
ERROR = re.compile(
    "|".join(
        (
            r"^(?:error[: ]+|http(?: status)?[: ]+|status[: ]+|code[: ]+)?[1-5]\d\d(?:\s*[-–—:|]\s*|\s+)(?:not found|gone|bad gateway|forbidden|unauthori[sz]ed|internal server error|service (?:temporarily )?unavailable|gateway time-?out|too many requests|access denied|page not found|bad request|we could not serve this)\b",
            r"\b(?:page|file|document|address|resource|url|site|link) (?:you (?:requested|asked for|are looking for|were looking for|want(?:ed)?)|requested|/\S+)? ?(?:could not|cannot|can't|can’t|was not|is not|wasn't) (?:be )?(?:found|displayed|reached|opened|available|served)\b",
            r"\b(?:requested|wanted) (?:page|file|document|address|url|resource)\b.{0,80}\b(?:not found|was not found|does not exist|could not be found)\b",
            r"\bthis (?:site|page) (?:can't|can’t|cannot|could not) be (?:reached|displayed|found|shown|loaded)\b",
            r"^(?:nobody|no one|we) (?:could|can|was able to|were able to) ?(?:not )?(?:find|load|open|show|display|reach) (?:this|that|the) (?:requested )?\w+[.!]*$",
            r"^we (?:failed|were unable|are unable) to (?:find|load|open|show|display|reach) (?:this|that|the)\b",
            r"^an? (?:unexpected |internal |unknown )?error (?:has )?occurred\b",
            r"^(?:page cannot be displayed|page not found|nothing to see here|not found|access denied|forbidden|bad gateway|request blocked|too many requests|service (?:temporarily )?unavailable|internal server error|database connection failed|oops|unauthori[sz]ed|something went wrong(?: on our side)?|gateway time-?out)\s*[.!]*$",
            r"^sorry, (?:we looked|the page|that page|this page|we could not|we couldn't|something)\b.*\b(?:gone|found|wrong|exist|unavailable)\b",
            r"^the connection (?:was|has been) reset\b",
            r"^(?:your|the) (?:session|login) has (?:expired|ended|timed out)\b",
            r"^you (?:do not|don't|don’t) have (?:permission|access|the rights?) to (?:view|open|see|access|read)\b",
            r"^you (?:may|can|must) not (?:open|view|see|read|access) this \w+\b",
            r"^this \w+ is private or does not exist\b",
            r"^we are (?:down|offline) for maintenance\b|^(?:the )?(?:site|service) is (?:down|offline) for maintenance\b",
            r"^th(?:e|is) \w+ has (?:moved|been moved|been removed)\b",
            r"^seite nicht gefunden\b|\bdie gewünschte (?:adresse|seite|datei) (?:gibt es|existiert|wurde)\b|\bzugriff (?:verweigert|nicht erlaubt)\b",
            r"\baccès refusé\b|\bvous ne pouvez pas (?:consulter|voir|ouvrir) cette page\b|\bpage (?:introuvable|non trouvée)\b",
            r"\bla página que buscas\b|\bpágina no encontrada\b|\bacceso denegado\b",
            r"страница не найдена|доступ (?:запрещ[её]н|закрыт)|ошибка [45]\d\d",
            r"(?:ページ|ファイル)が見つかりません|アクセスが(?:拒否|禁止)|エラー ?[45]\d\d|お探しのページ",
            r"(?:页面|网页|文件)(?:不存在|未找到|找不到)|(?:拒绝访问|访问被拒绝)|错误 ?[45]\d\d|您(?:访问|查找)的页面",
        )
    ),
    re.I,
)
#: A reply of a server in the notation of machines.
PAYLOAD = re.compile(r'^\{"(?:error|errors|status|code|message)": ?[\[{"\d].*\}$|^<error>.*</error>$', re.I)
#: Sentences that explain, quote, report or define such things rather than being them.
REPORTED = re.compile(
    r"\b(?:linter|rejects?|reports?|reported|was shown|were shown|answers?|handler|means? that|means the|(?:was|were) renamed|replaces|was replaced|renderer|format string|export it|reads? .{0,40} at start|"
    r"works without|worked without|explains?|wherever|stands? for|for example|in the page templates|look at the|is an integer|checks? (?:for|that)|users? (?:see|saw|get|got)|instead of showing|test names|such as|fixed:|"
    r"returned by|when the (?:server|service)|responds? with|logs?|documented|called)\b|^(?:get|post|put|delete|patch) /",
    re.I,
)
#: The head of an error page: a word for it, the code, and few words more; says what it is by itself.
ERROR_HEAD = re.compile(r"^(?:http(?:/\d\.\d)?(?: (?:status|error))?|error|status|code|fehler|erreur|ошибка|エラー|错误)(?: code)?[: #]*(?:n° ?)?[45]\d\d(?!\w)[\s.:,–—\-]*(?:\S+(?: |$)){0,8}$", re.I)
# Words that running text in the languages at hand hardly does without.
_COMMON = frozenset("the a an of and or is are to in on for with that this it as by be not el la los las un una de que y en por con para der die das den und ist ein eine le les des du et est une pour dans".split())
QUOTED = re.compile(r'"[^"\n]{0,200}"|“[^”\n]{0,200}”|„[^“”\n]{0,200}[“”]|`[^`\n]{1,200}`')
CODE_LINE = re.compile(
    r"^\s*(?:def |async def |class |func |fn |pub |static |import |from \S+ import|return\b|if .*[:{]\s*$|for .*[:{]\s*$|while .*[:{]\s*$|else\b|elif |export |const |let |var |public |private |protected |function |"
    r"local |end\b|[})\]];?,?\s*$|[\w.\[\]\"']+ ?(?:[-+*/]?=|<<|:=) ?\S|@\w+(?:[.(]|$)|File \"|Traceback|\w+Error\b|\$ |> |log\.|\w+\(.*\);?\s*$|/\*|\*/|\* ?@|\"\"\"|''')"
)
CHROME = re.compile(
    r"^(?:menu|skip to content|home(?: \| \w[\w ]*)+|terms(?: · \w+)+|© \d{4}.*|report a problem|back to the start page|loading…?|sign in|search|request id: \S+|reload afterwards|check the link and try again|go back or use the search)[.!]*$",
    re.I,
)
_SENTENCE_END = re.compile(r"[.!?]\s+|[。！？]")
# A closing fence is at least as long as its opening one; backticks with more of them on the line are a span.
_FENCE = re.compile(r"^ {0,3}(?:(`{3,})(?!`)[^`\n]*|(~{3,})(?!~)[^\n]*)(?:\n|\Z).*?(?:^ {0,3}(?:\1`*|\2~*)[ \t]*$|\Z)", re.M | re.S)
_LINE_END = re.compile(r"\r\n?")
_WORD = re.compile(r"[^\W\d_]+")
_COMMENT = re.compile(r"^\s*(?://+|\*+|--|;+|#+(?![A-Z{]))\s?")
_AFTER = re.compile(r"[={};<>]|\(\w*\)|\w\(|->|\+\+|&&|\|\|")


def _prose(line: str) -> bool:
    return not CODE_LINE.match(line)


def dummy_latin(sentence: str) -> bool:
    words = _WORD.findall(sentence.lower())
    if len(words) < 4:
        return False
    known = [w for w in words if w in LATIN]
    distinct = len(set(known))
    if distinct >= 3 and len(known) >= 0.25 * len(words):
        return True
    return len(words) >= 6 and distinct >= 2 and len(known) >= 0.12 * len(words) and not any(w in _COMMON for w in words)


_KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_STARTS = frozenset(["x", "xx", "xxx", *(k[i : i + 3] for k in _KEYS for i in range(len(k) - 2))])


def mashed(sentence: str) -> bool:
    """Keys hit in a row, or x's in the place of words."""
    words = _WORD.findall(sentence.lower())
    if len(words) < 4 or sum(w[:3] in _STARTS for w in words) < 0.8 * len(words):
        return False
    runs = sum(len(w) >= 3 and (len(set(w)) == 1 and w[0] == "x" or any(w[:3] in k and all(p in k for p in (w[-3:],)) for k in _KEYS)) or set(w) == {"x"} for w in words)
    return runs >= 0.8 * len(words)


def open_value(line: str) -> bool:
    """A placeholder in a line of prose, or a line that is little else."""
    if not PLACEHOLDER.search(line):
        return False
    plain = QUOTED.sub(" ", line)
    if not PLACEHOLDER.search(plain) or REPORTED.search(plain):
        return False
    rest = PLACEHOLDER.sub(" ", plain)
    if _AFTER.search(rest) or re.match(r"^\s*(?:export |let |const |var |echo |\$ )", line):
        return False
    return True


#: Characters that a rule's letters match too, case aside, and that ``lower`` doesn't turn into them.
_FOLD = str.maketrans("ıİſᲀᲁᲂᲃᲄᲅᲆᲇ", "iisвдосттъѣ")


def _fold(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLD).lower()


def _needed(tree) -> frozenset[str] | None:
    """Literals of which any match of a parsed pattern holds one, in lower case; None if there are none."""
    best: list[frozenset[str]] = []
    run = ""
    for op, value in [*tree, (None, None)]:
        if op is _parser.LITERAL:
            run += _fold(chr(value))
            continue
        found, repeated = None, op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and value[0] > 0
        if repeated and all(o is _parser.LITERAL for o, _ in value[2]):
            run += "".join(_fold(chr(c)) for _, c in value[2])
        elif repeated:
            found = _needed(value[2])
        elif op is _parser.SUBPATTERN:
            found = _needed(value[-1])
        elif op is _parser.BRANCH:
            parts = [_needed(x) for x in value[1]]
            found = None if None in parts else frozenset().union(*parts)
        best += [x for x in (found, frozenset([run]) if run else None) if x]
        run = ""
    return max(best, key=lambda x: min(map(len, x)), default=None)


_automaton = None


def _rules(text: str) -> int:
    """Bits of those of _SENTENCE whose literals the text holds; the others can't match it."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        bits: dict[str, int] = {}
        for k, rule in enumerate(_SENTENCE):
            for w in _needed(_parser.parse(rule.pattern, rule.flags)):
                bits[w] = bits.get(w, 0) | 1 << k
        a = ahocorasick.Automaton()
        for w, x in bits.items():
            a.add_word(w, x)
        a.make_automaton()
        _automaton = a
    found = 0
    for _, x in _automaton.iter(_fold(text)):
        found |= x
    return found


_SENTENCE = (FILLER, SCRIPTS, ERROR)
_OPEN = re.compile(r"\{[{%\d]|<[%YIEAFPTyieafpt%]|\$[{(]|#[{A-Z]|%[(A-Z]|@@|__[A-Z]|\[[\[A-Za-z]|\(\(|«")
_BULLET = re.compile(r"^(?:[-*>•]|\d+\.)\s+")
_TITLED = re.compile(r"^(?:#+ )?\S{1,70}(?: - \S{1,70})?$")
_LINES = re.compile(r"[\r\n]+")
_DIGIT = re.compile(r"\d")

#: A text of up to so many distinct passages is judged by the sentence rules.
ALONE = 4


def _unquoted(sentence: str) -> str:
    return QUOTED.sub(" ", sentence) if '"' in sentence or "`" in sentence or "“" in sentence or "„" in sentence else sentence


def skeleton(passage: str) -> str:
    """The passage without what varies between copies of one template: case and numbers."""
    return _DIGIT.sub("0", passage.lower())


def read(text: str | None) -> tuple[bool, list[str]]:
    """Whether the text shows residue by itself, and its distinct passages of prose that report nothing, in order."""
    if not text or not text.strip():
        return False, []
    evident = False
    passages: dict[str, None] = {}
    words = set(_WORD.findall(text.lower()))
    # Dummy Latin and mashed keys take several words of their kind; few texts have them.
    odd = len(words & LATIN) > 1 or any(w[:3] in _STARTS for w in words)
    for raw in _LINES.split(_FENCE.sub("\n", _LINE_END.sub("\n", text))):
        line = raw.strip()
        if not line:
            continue
        if line[0] in "{<" and PAYLOAD.search(line):
            evident = True
        code = not _prose(raw)
        if _OPEN.search(line) and open_value(line) and (not code or _TITLED.match(line)):
            evident = True
        if code:
            continue
        prose = _COMMENT.sub("", raw)
        start = 0
        for end in [*(m.end() for m in _SENTENCE_END.finditer(prose)), len(prose)]:
            passage = _BULLET.sub("", _unquoted(prose[start:end]).strip())
            start = end
            if passage and passage not in passages:
                passages[passage] = None
                evident = evident or odd and (dummy_latin(passage) or mashed(passage))
    return evident, list(passages)


def trusted(passages: list[str]) -> list[str]:
    """Those passages of a text by which the sentence rules call it residue; none if it has other content too."""
    if len(passages) > ALONE:
        return []
    found = []
    for p in passages:
        bits = _rules(p)
        if ERROR_HEAD.match(p) or any(bits >> k & 1 and rule.search(p) for k, rule in enumerate(_SENTENCE)) and not REPORTED.search(p):
            found.append(p)
    return found

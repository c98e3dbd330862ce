"""Notices by which a file says that it isn't hand-written: in its path, in its leading comment, or by the declaration that opens it."""

from __future__ import annotations

import re

# Folders of third-party copies and of generator output, and names tools give to their output.
_VENDORED_DIR = re.compile(r"(?:^|/)(?:vendor|vendored|third[_-]?party|3rd[_-]?party|node_modules|bower_components|jspm_packages|site-packages|dist-packages|pods|carthage|godeps|extern|externals?)/", re.I)
_GENERATED_DIR = re.compile(r"(?:^|/)(?:gen|generated|__generated__|auto[_-]?generated|generated[_-](?:src|sources?|code)|codegen[_-]out)/", re.I)
_GENERATED_NAME = re.compile(r"(?:^|/)(?:zz_generated[._][^/]*|[^/]+\.(?:generated|gen|g|designer)\.\w+|[^/]+_generated\.\w+|[^/]+\.pb\.(?:go|cc|h|rs)|[^/]+\.pb\.gw\.go|[^/]+_pb2(?:_grpc)?\.pyi?|[^/]+_pb\.(?:js|ts|rb)|[^/]+\.freezed\.dart)$", re.I)
_MINIFIED_NAME = re.compile(r"(?:^|/)[^/]+(?:[.\-]min|\.bundle|\.chunk|\.prod)\.(?:js|css|mjs|cjs)$|(?:^|/)[^/]+[.\-](?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{8,20}\.(?:js|css|mjs|cjs)$|(?:^|/)[^/]+\.\d{8,20}\.(?:js|css|mjs|cjs)$", re.I)
_RELEASE_NAME = re.compile(r"(?:^|/)[A-Za-z][\w.]*(?:-[A-Za-z]\w*)*-v?\d+\.\d+(?:\.\d+)?(?:[.\-](?:min|slim|esm|umd))?\.\w+$")

GENERATED_NOTICE = re.compile(
    r"\bcode generated by\b.*\b(?:do not edit|don't edit)\b|@generated\b|<auto-?generated\b|^\W*auto-?generated (?:file|code|by|on|from|with)\b|^\W*automatically generated\b|"
    r"\bthis (?:file|code|source|module|class|script) (?:was|is|has been) (?:produced|generated|created|written|built|made) (?:automatically|mechanically|by (?:a |the )?(?:tool|generator|script|machine|program|compiler))\b|"
    r"\bthis (?:file|code|source|module|class|script) (?:was|is|has been) (?:auto-?generated|automatically (?:generated|produced|created))\b|^\W*generated (?:by|from|with|automatically)\b|"
    r"\bmanual (?:edits|changes|modifications) (?:will|would|may|are going to) be (?:overwritten|lost)\b|\b(?:edits|changes) (?:here|to this file) will be (?:overwritten|lost)\b|"
    r"^\W*output of \w+ (?:for|from)\b.*\b(?:edit|instead of)\b|\b(?:please )?do not (?:edit|modify|change)(?: this file)?(?: by hand| manually)?\b.*\bgenerat|\bautogenerated on\b|\bplease do not (?:modify|edit|change) by hand\b|"
    r"\bwurde (?:von \S+|automatisch) (?:erzeugt|generiert|erstellt)\b|\bnicht von hand (?:ändern|bearbeiten)\b|\b(?:fichier|code) généré (?:par|automatiquement)\b|\b(?:archivo|fichero|código) generado (?:por|automáticamente)\b|"
    r"сгенерирован (?:автоматически|с помощью)|自动生成|自動生成",
    re.I,
)
VENDORED_NOTICE = re.compile(
    r"^\W*vendored (?:from|copy of)\b|\bcopied (?:verbatim|unchanged|unmodified)\b.{0,20}\bfrom\b|\bthis is a (?:bundled|vendored|local|verbatim|third-party) copy of\b|\breport bugs to the \S+ (?:project|authors|maintainers)\b|"
    r"^\W*[\w\-.]+ v?\d+\.\d+(?:\.\d+)? \| \(c\)|^\W*[\w\-.]+ - version \d+\.\d+|\bkeep in sync with upstream\b|\bcopyright \(c\) (?:\d{4}[-, \d]* )?the [\w\-. ]+ (?:authors|contributors)\b|"
    r"\bpermission is (?:hereby )?granted\b.*\b(?:redistribute|free of charge|copy)\b|\bunmodified copy of\b|\bimported from \S+@\w+",
    re.I,
)
#: Says the contrary, or only talks about such files.
_DENIED = re.compile(r"\b(?:not|isn't|never|no longer) (?:auto-?)?generated\b|\bwritten by hand\b|\bhand-?written\b|\bmarked as\b|\bchecks? that\b|\bre-?generate\b|\bwhich (?:writes|emits)\b", re.I)
_COMMENT_LINE = re.compile(r"^\s*(?://|#(?!include|define|if|else|endif|pragma|\[)|/\*|\*|--|;|<!--|\"\"\"|''')")
_MAP = re.compile(r"^\s*(?://|/\*)[#@] ?sourceMappingURL=", re.M)
_MAP_LINE = re.compile(_MAP.pattern + r".*$", re.M)


def path_notice(path: str | None) -> bool:
    p = (path or "").replace("\\", "/")
    return bool(_VENDORED_DIR.search(p) or _GENERATED_DIR.search(p) or _GENERATED_NAME.search(p) or _MINIFIED_NAME.search(p) or _RELEASE_NAME.search(p))


def leading_comment(text: str) -> tuple[list[str], int]:
    """Lines of the comments before any code, and where the rest starts."""
    lines = text.replace("\r\n", "\n").split("\n")
    out, i, block = [], 0, ""
    while i < len(lines):
        s = lines[i].strip()
        if block:
            out.append(s)
            if block in s:
                block = ""
        elif not s or s.startswith(("#!", "<?php", "<?xml", "package ")):
            pass
        elif s.startswith("/*"):
            out.append(s)
            block = "" if "*/" in s[2:] else "*/"
        elif s.startswith(('"""', "'''")):
            out.append(s)
            block = "" if s[:3] in s[3:] else s[:3]
        elif s.startswith("<!--"):
            out.append(s)
            block = "" if "-->" in s else "-->"
        elif _COMMENT_LINE.match(s):
            out.append(s)
        else:
            break
        i += 1
    return out, i


def text_notice(first: str | None) -> bool:
    """A notice in the leading comment of a file's first text, or a source map reference at its end."""
    if not first:
        return False
    comment, _ = leading_comment(first)
    if _MAP.search(first):
        return True
    prose = [re.sub(r"^(?:/\*+!?|//+!?|#+|\*+|--+|;+|<!--|\"\"\"|''')\s?", "", c).strip() for c in comment]
    if _DENIED.search(" ".join(prose)) and not any(re.search(r"\bdo not edit\b|@generated|overwritten", p, re.I) for p in prose):
        return False
    return any(GENERATED_NOTICE.search(p) or VENDORED_NOTICE.search(p) for p in prose)


#: The declaration of a table, a blob or rows to insert, whose values only follow.
_OPENING = re.compile(r"^\s*(?:insert\s+into\b.*\bvalues\b.*|(?:export\s+default|return)\s*[\[({]\s*|[^()=]*[^()=!<>]=\s*[\[({]\s*)$", re.I)


def opening_notice(first: str | None) -> bool:
    """Whether the first line of code only opens a table of values."""
    return bool(first and _OPENING.match(_head(first)[1]))


def _head(text: str) -> tuple[int, str]:
    """Number and text of the first line of code."""
    lines = text.replace("\r\n", "\n").split("\n")
    at = leading_comment(text)[1]
    return at, lines[at] if at < len(lines) else ""


def hidden(first: str) -> str:
    """The text without what the notices are read from: leading comment, opening declaration and source map line."""
    at, head = _head(first)
    rest = "\n".join(first.replace("\r\n", "\n").split("\n")[at + bool(_OPENING.match(head)) :])
    return _MAP_LINE.sub("", rest)

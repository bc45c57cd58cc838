"""Wording of template residue, filler, error and block messages, and demands for scripts; unfilled slots.

The phrases are fixed values, stated as text. Patterns are anchored or need the whole phrase, so that a sentence which
merely mentions an error is none.
"""

from __future__ import annotations

import re
from functools import lru_cache

from assaykit.llm.textforms import words_of

_STATUS = r"(?:not found|bad request|forbidden|unauthorized|gone|internal server error|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|too many requests|request time-?out|connection timed out|unknown error|(?:access )?denied|method not allowed)"

#: Messages that stand where content should be.
MESSAGE = re.compile(
    r"(?i)^\W*(?:"
    rf"(?:http(?: error| status)?|error|fehler|错误|status)?\W*(?:[45]\d\d|<\*>)\W*{_STATUS}\W*$|(?:http error|error|fehler|错误|http|status)\W*(?:code\W*)?(?:[45]\d\d|<\*>)(?:\W*{_STATUS})?\W*$|err_[a-z_]+\W*$|{_STATUS}\W*$|"
    r"(?:oops|ups|hoppla)\b|page not found|the page (?:you|was|could)|this page (?:does not exist|could not|is not available)|sorry, (?:the|this|we|our)\b.*(?:not|without)|access denied|your request (?:was|has been) blocked|request id\b|reference \S+$|ray \S+$|"
    r"(?:the |this )?(?:site|website|page|service) is (?:currently |temporarily )?(?:under maintenance|unavailable|down|offline)|site under maintenance|please come back later|please try again|try again later|something went wrong|the server (?:met|encountered|is)|"
    r"error establishing a database connection|database error|(?:this )?account (?:has been )?suspended|account suspended|session expired|go back\W*$|return to the home ?page|back to the home ?page|"
    r"seite nicht gefunden|die (?:angeforderte|gesuchte) seite|zugriff verweigert|wartungsarbeiten|bitte versuchen sie es später|página no encontrada|la página (?:solicitada|que busca)|acceso denegado|sitio en mantenimiento|"
    r"this domain (?:may be|is) for sale|make an offer\W*$|if nothing happens|noscript\b|返回上一页|抱歉|页面不存在|您访问的页面|访问被拒绝|网站维护|服务器(?:内部)?错误|"
    r"el enlace no funciona|please get in touch with your hosting|if you own this site|you don.t have permission|time: ?(?:\d+|<\*>)\W*$|the requested url|your connection timed out|too many requests|fatal error|traceback|(?:key|type|value|name|attribute|index|runtime|syntax)error\b|uncaught \w+|file \"[^\"]+\", line|\s*at \w+\.\w+\(|exception in|warning: \w+\(\)|notice: undefined|"
    r"(?:please )?(?:enable|turn on|activate|allow) (?:js|javascript|scripts?|cookies)|(?:you need to|please) enable|cookies (?:and \w+ )?(?:are|must be) (?:required|enabled)|javascript (?:is )?(?:required|disabled|must)|(?:js|(?:java)?script(?:s|ing)?)(?: and cookies)? (?:seems?|is|are) (?:to be )?(?:off|disabled|required|needed)|"
    r"(?:this|the|our) \w+ (?:requires?|needs) (?:js|javascript|scripts?|scripting)|without (?:js|(?:java)?script(?:s|ing)?)(?: and cookies)?\b.*(?:no content|nothing|cannot|not)|your browser (?:does not|doesn't|has no) (?:support|run|scripts?)|turn (?:them|it) on and reload|enable scripts|scripts? (?:are|is) required|"
    r"bitte aktivieren sie|aktivieren sie (?:bitte )?javascript|javascript (?:ist )?(?:erforderlich|deaktiviert)|(?:por favor,? )?(?:active|habilite|activa) javascript|(?:请|需要)?(?:在浏览器中)?启用\s*javascript|"
    r"verify(?:ing)? (?:that )?you are (?:a )?human|checking your browser|just a moment|attention required|this takes a few seconds|loading\W*$|please wait\W*$|are you a robot|complete the captcha|one more step|正在加载"
    r")"
)

#: Filler and what programs print for nothing.
FILLER = re.compile(
    r"(?i)^\W*(?:(?:undefined|null|nan|none|\[?object object\]?|nil|true|false)(?:\W+(?:undefined|null|nan|items?))*\W*$|<p>\s*</p>|&nbsp;|(?:text ){2,}text\W*$|(?:asdf\W*)+$|(?:x{2,}\W*)+$|"
    r"(?:this is )?(?:a )?(?:sample|placeholder|dummy|example) (?:text|paragraph|headline|image|caption|block|title|content)\b(?=\W*$|[.,:;!–-]| [(–-])|placeholder\b|dummy \w+|blindtext|platzhalter|hier steht ihr text|texto de (?:ejemplo|relleno)|示例文字|此处填写|占位|在此输入|"
    r"(?:[\w]+ ){0,3}goes here\W*$|your (?:content|text|headline|title) (?:goes )?here|(?:type|enter|add|write) your \w+|insert \w+(?: \w+)? here|(?:description|content|text) (?:coming soon|to follow)|\[?[\w ]+ to follow\]|[\w ]+: add content\W*$|"
    r"click (?:here )?to edit|some quick example|add a short description|hello world|another page of this theme|edit (?:this|or delete) |todo\b|(?:sub|card )?title (?:\d+|<\*>)\W*$|(?:headline|section|block|paragraph|company text|product description|description|image caption|team member) (?:\d+|<\*>)\W*$|[\w ]+ – lorem\W*$|lorem\b|edge-(?:\d+|<\*>)\W*$)"
)
_LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)

#: Titles that programs set where nobody wrote one.
DEFAULT_TITLE = re.compile(
    r"(?i)^\W*(?:untitled(?:[ -]?(?:document|page|\d+))?|unbenannt\w*(?: dokument)?|unbenanntes dokument|documento sin título|sin título|无标题(?:文档)?|your site name|site name|page title|title goes here|title|lorem ipsum.*|just another (?:wordpress )?site|new page(?: \d+)?|sample page|index of /.*|default(?: web site)? page|welcome to nginx|"
    r"it works|document|home ?page title|undefined|null|nan|\[object object\]|hello world|test page|coming soon|seitentitel|título de la página|网页标题)\W*$"
)

_NAME = r"(?:[A-Za-z][\w.]*(?: [\w.]+){0,2})"
#: Bracket pairs of template languages around a field name.
SLOT = re.compile(rf"\{{\{{\s*{_NAME}\s*\}}\}}|\$\{{\s*{_NAME}\s*\}}|<%=?\s*{_NAME}\s*%>|\[\[\s*{_NAME}\s*\]\]|__{_NAME}__|%{_NAME}%|#{_NAME}#|\{{{_NAME}\}}|<{_NAME}>|\[{_NAME}\](?!\()")
_SURE_SLOT = re.compile(rf"\{{\{{\s*{_NAME}\s*\}}\}}|\$\{{\s*{_NAME}\s*\}}|<%=?\s*{_NAME}\s*%>|\[\[\s*{_NAME}\s*\]\]|__[A-Za-z][\w. ]*__")
_OPENERS = re.compile(r"[{<\[%#_]")
_FRAME = re.compile(r"(?i)^(?:welcome to|contact .* for|since .*:|founded in .*we serve customers|our .* plant makes|.* is a leading supplier of .* in|willkommen bei|bienvenidos? a|欢迎)")


#: Characters of the longest line that is asked for known wordings; longer ones are messages by their templates or as filler.
LONGEST = 240


def lorem_like(text: str) -> bool:
    words = words_of(text)
    if _LOREM.isdisjoint(words):
        return False
    latin = [w for w in words if w[0] < "\u2e80"]
    return len(latin) >= 3 and sum(w in _LOREM for w in latin) >= 0.6 * len(latin)


@lru_cache(maxsize=30_000)
def is_message(text: str) -> bool:
    """True for the text of a message, notice or filler; long running text is only tested for filler words."""
    t = text.strip()
    if not t:
        return False
    if lorem_like(t):
        return True
    return len(t) <= LONGEST and bool(MESSAGE.match(t) or FILLER.match(t))


def has_open_slot(text: str) -> bool:
    """True if the text is made around unfilled slots: at least one, and no sentence that stands without them.

    Doubled or otherwise unmistakable brackets always count; single ones count if they make up the text or fill a frame.
    """
    if not _OPENERS.search(text):
        return False
    t = text.strip()
    if not SLOT.search(t):
        return False
    rest = re.sub(r"[\W_]+", "", SLOT.sub("", t))
    return not rest or bool(_SURE_SLOT.search(t)) or (bool(_FRAME.match(t)) and len(t) < 160)


def title_parts(title: str) -> list[str]:
    return [p.strip() for p in re.split(r"\s+[|–—-]\s+|\s*\|\s*", title) if p.strip()]


@lru_cache(maxsize=50_000)
def is_bad_part(part: str) -> bool:
    """A part of a title, or a whole one, that is a message, filler, an unset default or holds an open slot for sure."""
    return bool(part) and bool(DEFAULT_TITLE.match(part) or is_message(part) or SLOT.fullmatch(part) or _SURE_SLOT.search(part))


def is_bad_title(title: str) -> bool:
    """A title that is a message, filler, an unset default or an unfilled slot, with or without a name beside it."""
    t = title.strip()
    return any(map(is_bad_part, [t, *title_parts(t)])) if t else False

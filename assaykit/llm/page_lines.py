"""Lines of a page section that speak for themselves: what is sure to be content or site furniture by wording or form.

``seed`` labels such lines; all others, and the costs of all, are left to the fitted model (``line_model``) and the cut. The cue
lists are fixed values, stated as text.
"""

from __future__ import annotations

import re
from functools import lru_cache

from assaykit.llm.residue import is_message

#: Labels of menus, in the languages of the data.
NAV_LABELS = frozenset(x.casefold() for x in (
    "Home|Products|Applications|About us|About|News|Downloads|Contact|Careers|Quality|References|Media|Locations|Sustainability|Login|Shop|Service|Services|Search|Menu|Company|Sitemap|Blog|Imprint|Privacy|"
    "Startseite|Produkte|Anwendungen|Über uns|Aktuelles|Kontakt|Karriere|Qualität|Standorte|Presse|Referenzen|Nachhaltigkeit|Unternehmen|Suche|Menü|Navigation|"
    "Inicio|Productos|Aplicaciones|Empresa|Noticias|Descargas|Contacto|Empleo|Calidad|Delegaciones|Referencias|Sostenibilidad|Prensa|Tienda|Acceso|Buscar|Menú|Servicio|Medios|"
    "首页|产品中心|应用领域|关于我们|新闻动态|资料下载|联系我们|人才招聘|质量体系|在线留言|导航|搜索|公司简介|新闻中心|菜单|登录").split("|"))

#: What stands alone in frames of pages everywhere.
FRAME_LINES = frozenset(x.casefold() for x in (
    "Related articles|Related posts|Recent posts|Most read|Share this page|Latest news|All news|You may also like|Categories|Leave a reply|Archive|Subscribe to our newsletter|Sign up|Back to top|Skip to content|Related products|Quick links|"
    "Nach oben|Das könnte Sie auch interessieren|Weitere Beiträge|Seite teilen|Newsletter abonnieren|Anmelden|Zum Inhalt springen|Ähnliche Produkte|Volver arriba|También le puede interesar|Artículos relacionados|Compartir|Últimas noticias|Saltar al contenido|"
    "返回顶部|相关产品|推荐阅读|友情链接|上一篇|下一篇").split("|"))

#: Buttons, headings and wording of consent notices (lower case).
_CONSENT_START = re.compile(
    r"(?:accept(?: all)?|allow all|reject(?: all)?|deny|settings|got it!?|ok|i agree|save choice|save and close|only necessary|more information|manage consent|"
    r"preferences|view preferences|functional – always active|your privacy matters to us|choose which|einverstanden|alle akzeptieren|alle annehmen|nur notwendige|ablehnen|einstellungen|aceptar(?: todo)?|rechazar|configurar|ajustes|cerrar|"
    r"同意|拒绝|设置|接受全部|知道了|关闭|close|agree|verstanden|akzeptieren|schliessen|auswahl speichern|speichern|guardar|de acuerdo|entendido)(?:$|[\s|·•/-])"
)
_CONSENT_WORDS = (
    "cookies", "cookie policy", "cookie settings", "cookie notice", "使用 cookie", "使用cookie", "datenschutzerklärung", "small files", "small text files", "隐私政策", "隐私声明", "speichert daten auf", "some are needed for the site to work",
    "almacena datos en su equipo", "stores files on your device", "stores data on your device", "files and count visits", "you can change this at any time", "puede cambiarlo cuando quiera", "以改善浏览", "您可随时更改", "您可以随时更改", "data on your device", "files on your device", "auf ihrem gerät", "en su dispositivo", "您的设备", "本站会在您的设备上",
)

#: What stands in footers (lower case).
_FOOTER_START = re.compile(
    r"©|copyright\b|备\s?\d|imprint\b|impressum\b|aviso legal|privac(?:y|idad)$|datenschutz$|agb$|terms$|rss$|hrb \d|company no\.|registered in |sitz \S+|inscrita en |"
    r"barrierefreiheit$|accessibility$|accesibilidad$|canal ético$|condiciones$|hinweisgeber$|whistleblowing$|druckansicht$|print view$|versión para imprimir$|last change \d|letzte änderung|stand \d{4}$|última actualización|member of the trade body$|data without warranty$|法律声明$|隐私$|打印$|网站地图|友情链接$|"
    r"opening hours|öffnungszeiten|horario|follow us|folgen sie uns|síganos|site by |certified to the usual|zertifiziert nach|cookie settings$|mapa web|营业时间|关注我们|技术支持"
)
_FOOTER_WORDS = ("版权所有", "备案号", "all rights reserved", "alle rechte vorbehalten", "todos los derechos reservados", "accepts no liability for", "ohne gewähr. für inhalte", "sin garantía", "不承担责任", "仅供参考")


def _consent(low: str) -> bool:
    return bool(_CONSENT_START.match(low)) or any(w in low for w in _CONSENT_WORDS)


def _footer(low: str) -> bool:
    return bool(_FOOTER_START.match(low)) or any(w in low for w in _FOOTER_WORDS)


_FOOTER_PARTS = re.compile(r"\s+[|·•-]\s+|\s{2,}|\s*\|\s*")
_BREADCRUMB = re.compile(r"^(?:home|startseite|inicio|首页)\s*[>/»›]\s*\S")
_BANNER = re.compile(r"^(?:some functions of this page need javascript|einige funktionen dieser seite benötigen javascript|algunas funciones requieren javascript|部分功能需要启用javascript|本站部分功能)")
_LANGS = re.compile(r"^(?:(?:EN|DE|ES|FR|IT|中文|English|Deutsch|Español)(?:\s+|\s*[|/·]\s*|$)){2,}$")
_TEASER = re.compile(r"…|\[\.\.\.\]|\.\.\.$|(?:» more|read on >|details|read more|mehr »|weiterlesen|leer más|阅读全文|详情)\s*$")
#: Files to load, counters of comments, lists of tags.
_BOX_ITEM = re.compile(r"\((?:pdf|doc|zip|xls)\b[^)]*\)|^\d+ (?:comments?|kommentare?|comentarios?)$|^\d+条评论|^(?:tags|schlagwörter|etiquetas|标签)\s*[:：]")
_SPEC = re.compile(r"^[A-Za-z][A-Za-z0-9]{0,9}\s*[:：]\s*[\d.,]+\s*(?:%|ppm|g|mm|°C)?$")
#: Units behind a figure at the end of a line.
_MEASURE = re.compile(r"\d\s?(?:mm|cm|m|µm|kg|g|t|l|%|°C|K|MPa|bar)$")
_BULLET = re.compile(r"^(?:[*•·\-–]|\d+[.)])\s+")
#: What menus and footers of several parts cannot do without.
_FRAME_MARKS = re.compile(r"[|•·»>/]|\]\(|\s{2}|\s-\s")
_LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)")
_ENDS = (".", "。", "!", "?", "！", "？", ":", "：", ";")


def nav_only(s: str) -> int:
    """Number of labels if the line consists of menu labels only, else 0."""
    linked = _LINK.sub(r" \1  ", s)
    bare = _BULLET.sub("", linked.strip())
    parts = [p.strip(" •·|").casefold() for p in re.split(r"\s{2,}|\s*[|•·/>»]\s*", bare) if p.strip(" •·|")]
    return len(parts) if parts and all(p in NAV_LABELS for p in parts) else 0


@lru_cache(maxsize=30_000)
def seed(line: str) -> int:
    """1 for lines that are sure to be content, -1 for furniture, 0 for all others; messages in place of a body are none of both."""
    s = line.strip()
    low = s.casefold()
    if not s or is_message(s):
        return 0
    if s[0] == "|" and s[-1] == "|" and s.count("|") >= 3 or _SPEC.match(s) or _MEASURE.search(s) or s[0] == "#" and s.lstrip("#")[:1] == " " or s[:2] == "**" == s[-2:]:
        return 1
    sure_text = s.endswith(_ENDS) and (len(s) > 60 or len(s) > 25 and not s.isascii())
    if sure_text and not _FRAME_MARKS.search(s):
        return -1 if _BANNER.match(low) or _TEASER.search(low) or _consent(low) or _footer(low) else 1
    if _BREADCRUMB.match(low) or _BANNER.match(low) or _LANGS.match(s) or low in FRAME_LINES or _TEASER.search(low) or _BOX_ITEM.search(low) and not sure_text:
        return -1
    if nav_only(s) or _consent(low) or _footer(low):
        return -1
    parts = [p for p in _FOOTER_PARTS.split(low) if p]
    if len(parts) > 1 and sum(1 for p in parts if p in NAV_LABELS or _footer(p) or _consent(p)) * 2 >= len(parts):
        return -1
    return 1 if sure_text else 0

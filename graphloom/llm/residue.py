"""Residue in place of content: unfilled templates, filler, error pages, access and script notices.

Three kinds of evidence are combined:

* *terms*: whether the words of the address slug and of the title come back in what the body says.  A
  page that answers something else than its address promised shares no term with it;
* *hosts*: the units (lines and sentences) of all documents are counted per host and title.  A response
  is served in the same words under many addresses, by several hosts, and stands alone wherever it is
  served, while a sentence of real pages also stands among others;
* *detectors*: slots of templates in whatever marks, filler, and the wording of notices, each only
  where it is used and not quoted.

Slots and filler decide by themselves.  Notices that outweigh the content decide if the body does not
answer its address or if several hosts serve the same wording.  A text without any known wording is a
response if all it says is mismatched, low in information, and served alone under several titles and hosts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import spread
from graphloom.runtime import Staging

# Placeholders of template languages and forms.
PLACEHOLDER = re.compile(
    r"""
    \{\{[#/>^&!]?\s*[\w.\-|: ]+\s*\}\}\}?            # mustache, jinja, handlebars
  | \{%[^%\n]*%\}                                     # jinja, liquid
  | <%[=\-]?[^%\n]*%>                                 # erb, ejs
  | \$\{[\w.\- ]+\} | \{[A-Z][A-Z0-9_. ]+\} | <<[^<>\n]{1,60}>> | \$[A-Z][A-Z0-9_]{2,}\b           # shell, velocity, js
  | \#(?:foreach|set|if|end|else|parse|include)\b
  | (?<![\w$])\$!?[a-z]\w*\.[a-z]\w*
  | \[(?:[A-Z][A-Z0-9 _/.\-]{2,}|(?:insert|describe|add|enter|your|name|link|todo|tbd|replace|fill|list|explain|write|example|optional|placeholder)\b[^\]\n]*)\](?!\()
  | <(?:your|insert|enter|add|name|title|placeholder|description|todo|owner|date|team|project|link)[\w \-]*>
  | __[A-Z][A-Z0-9_]*__ | %%?[A-Z][A-Z0-9_]{2,}%%? | %\([\w]+\)[sd] | (?<!\w)%[sd](?!\w) | @@[\w.]+@@ | \[object\s+Object\] | (?<!\w)\{\d\}(?!\w) | \{[a-z]+_[a-z_]+\}
  | \bcookiecutter\.\w+ | <!--\s*(?:delete|remove|replace|fill|describe|insert|add|write)\b[^>]*-->
    """,
    re.X,
)
PLACEHOLDER_CI = re.compile(r"\[(?:insert|describe|add|enter|your|replace|fill in|explain|write)\b[^\]\n]{0,80}\](?!\()", re.I)

# Filler.
FILLER = re.compile(
    r"\blorem\s+ipsum\b|\bdolor\s+sit\s+amet\b|\bconsectetur\s+\w*\s*adipi|\bsed\s+do\s+eiusmod\b|\but\s+enim\s+ad\s+minim\b|\bduis\s+aute\b|\bexcepteur\s+sint\b|\bquis\s+nostrud\b|\bin\s+reprehenderit\b"
    r"|\byour\s+text\s+(?:goes\s+)?here\b|\b(?:description|content|text|summary|title|details?|body|example)\s+goes?\s+here\b|^\s*(?:tbd|todo|tba|n/?a|fixme|xxx)\s*[.:]?\s*$"
    r"|\breplace\s+this\s+(?:block|text|section|paragraph|line|page)\b|\bsample\s+(?:heading|paragraph|text|title|content)\b|\bplaceholder\s+(?:text|content|page)\b"
    r"|\bcoming\s+soon\b|\bunder\s+construction\b|\bcheck\s+back\s+(?:later|soon)\b|\bto\s+be\s+(?:written|completed|filled\s+in|determined|added)\b|\bthis\s+(?:page|section)\s+(?:is|was)\s+(?:intentionally\s+)?(?:left\s+)?(?:empty|blank|a\s+stub)\b|\bnothing\s+here\s+yet\b"
    r"|\bhier\s+steht\s+(?:ihr|der|dein)\s+text\b|\bplatzhalter(?:text)?\b|\bdemnächst\b|\bim\s+aufbau\b|\btexto\s+de\s+(?:ejemplo|relleno|muestra)\b|\bpróximamente\b|\ben\s+construcción\b|\btexte\s+d['’]exemple\b|\bbientôt\s+disponible\b|\ben\s+construction\b"
    r"|\binsert(?:e|ar|er)?\s+(?:your\s+)?(?:text|content|title|copy|body)\b|\basdf\b|\bqwer(?:ty)?\b|^\W*(?:test(?:\s+test)+|foo\s+bar(?:\s+baz)?|bla(?:h)?\s+bla(?:h)?)\W*$",
    re.I | re.M,
)

# Wording of error pages and of access, script and waiting notices.
NOTICE = re.compile(
    r"""
    \b(?:cannot|can'?t|could\s+not)\s+be\s+(?:shown|displayed|rendered|opened)\b | \b(?:page|article|fiche)\b[^.\n]{0,30}\b(?:déplacée?|supprimée?)\b
  | \b(?:página|dirección)\b[^.\n]{0,40}\b(?:movid[ao]|eliminad[ao]|borrad[ao]|trasladad[ao])\b | \b(?:seite|adresse)\b[^.\n]{0,40}\b(?:verschoben|gelöscht|entfernt|umgezogen)\b
  | \b(?:page|file|resource|document|url|address|path|article|site|server|host)\b[^.\n]{0,60}\b(?:not|n[o']t|could\s+not|cannot|was\s+not|wasn'?t)\b[^.\n]{0,20}\b(?:be\s+)?(?:found|exist|available|loaded|reached|resolved|displayed)\b
  | \b(?:we|i)\s+(?:could\s*n[o']t|could\s+not|cannot|can'?t)\s+(?:find|load|show|open|display|reach)\b
  | \bcould\s+not\s+be\s+(?:found|loaded|reached|displayed|opened|completed|processed)\b
  | \bno\s+longer\s+(?:exists|available)\b | \bmay\s+have\s+been\s+(?:moved|removed|deleted|renamed)\b | \b(?:was|has\s+been)\s+moved\s+permanently\b
  | \bnot\s+found\b | \bbad\s+(?:gateway|request)\b | \bgateway\s+time-?out\b | \bservice\s+(?:is\s+)?(?:temporarily\s+)?unavailable\b | \binternal\s+server\s+error\b | \b(?:forbidden|unauthori[sz]ed)\b
  | \btemporarily\s+(?:unavailable|down|offline|out\s+of\s+service)\b | \bunavailable\b | \btoo\s+many\s+requests\b | \brate\s+limit(?:ed)?\b
  | \b(?:took|takes)\s+too\s+long\b | \btimed?\s+out\b | \btimeout\b | \bhas\s+expired\b | \bsession\s+(?:has\s+)?(?:expired|ended|timed\s+out)\b
  | \baccess\s+(?:is\s+)?(?:denied|restricted|forbidden)\b | \b(?:do\s+not|don'?t)\s+have\s+(?:permission|access|the\s+rights)\b | \bnot\s+(?:allowed|permitted|authori[sz]ed)\s+to\b
  | \b(?:sign|log)\s*[- ]?in\b | \blogin\s+(?:is\s+)?required\b | \bauthentication\s+(?:is\s+)?required\b | \bmembers\s+only\b | \bsubscri(?:be|bers?|ption)\b[^.\n]{0,40}\b(?:continue|only|read|required)\b
  | \b(?:enable|turn\s+on|allow|activate|switch\s+on)\b[^.\n]{0,40}\b(?:java\s*script|scripts?|cookies?)\b | \b(?:java\s*script|scripts?|cookies?)\b[^.\n]{0,40}\b(?:disabled|required|enabled|turned|switched|needed|on\s+in\s+your\s+browser)\b
  | \bneeds?\s+(?:java\s*)?scripts?\b | \brequires?\s+(?:java\s*script|scripts|cookies|a\s+newer\s+browser)\b | \bbrowser\s+(?:is\s+)?not\s+supported\b | \b(?:your|this)\s+browser\b | \bunsupported\s+browser\b
  | \b(?:checking|verifying)\s+(?:your|that\s+you|if\s+you)\b | \bverify\s+(?:that\s+)?you\s+are\b | \b(?:not\s+a|are\s+you\s+a)\s+robot\b | \bcaptcha\b | \bunusual\s+traffic\b
  | \btry\s+(?:again|later)\b | \breload\b[^.\n]{0,20}\b(?:page|to)\b | \band\s+(?:reload|retry)\b | \bplease\s+wait\b | \bwait\s+\d+\s+seconds?\b | \bredirect(?:ed|ing)\b | \bloading\s+\w+[^.\n]{0,30}(?:\.\.\.|…) | ^\s*loading\b
  | \bsomething\s+went\s+wrong\b | \ban?\s+(?:unexpected\s+|unknown\s+|template\s+)?error\s+(?:has\s+)?occurred\b | ^\W*(?:error|http|status)\s*:?\s*\d{3}\b | ^\W*\d{3}\s+(?:error|not|bad|service|gateway|forbidden|unauthori|internal|too|moved)
  | \b(?:scheduled|planned|under|for)\s+maintenance\b | \bmaintenance\s+mode\b | \braised\s+\w*(?:error|exception|reference)\b | \b(?:null\s*reference|null\s*pointer|undefined\s+variable|stack\s*trace|traceback)\b | \btemplate\s+\S+\s+(?:raised|failed|missing)
  | \b(?:was|were|been)\s+rejected\b[^.\n]{0,10}\bcode\b | \breturned\s+an?\s+\w+\s+(?:reply|response)\b | \bcould\s+not\s+be\s+rendered\b | \brestricted\s+to\s+(?:members|users|staff)\b | \btaken\s+offline\b | \bneeds?\s+a\s+(?:sign|log) | \bgo\s+(?:back|home)\b | \btrace:\s*[0-9a-f]{6,}\b | \bmay\s+have\s+been\s+\w+\s+by\b | \bno\s+longer\s+(?:published|hosted|served|online|supported\s+here)\b | \bwas\s+blocked\s+by\b | \bdoes\s+not\s+exist\b | \bexist(?:iert|ieren)\s+nicht\b | \bya\s+no\s+existe\b | \bn['’]existe\s+plus\b | \brequires?\s+(?:cookies|scripts|java\s*script)\b | \bback\s+to\s+the\s+start\b | \bvuelva\s+al\b | \bretour\s+à\b | \bzurück\s+zu\w*\b | \bif\s+this\s+(?:persists|continues|keeps)\b | \bnot\s+available\s+right\s+now\b | \bexceeded\s+for\b
  | \b(?:request|incident|reference|trace|correlation|ray)\s+(?:id|number)\b | \bclear\s+your\b | \bsorry\b | \boops\b | \bwe\s+are\s+sorry\b | \bcontact\s+(?:the\s+)?(?:administrator|support|space\s+owner|webmaster)\b | \bask\s+(?:the|your|an)\s+(?:space\s+owner|admin\w*|owner)\b
  | \b(?:seite|datei|adresse)\b[^.\n]{0,50}\bnicht\s+(?:gefunden|verfügbar|erreichbar)\b | \bzugriff\s+(?:verweigert|nicht)\b | \bbitte\s+(?:aktivieren|melden|warten|versuchen|laden)\b | \b(?:vorübergehend|derzeit|zurzeit)\s+nicht\s+(?:verfügbar|erreichbar)\b | \banmelde(?:n|ung)\b | \bes\s+ist\s+ein\s+fehler\b | \b(?:java\s*)?s[ck]ripte?\s+(?:aktivieren|einschalten)\b | \b(?:wartungsarbeiten|weitergeleitet)\b | \bsitzung\b[^.\n]{0,20}\babgelaufen\b
  | \bpágina\b[^.\n]{0,40}\bno\s+(?:se\s+)?(?:encontr|existe|está)\w* | \bno\s+encontrad[ao]\b | \bacceso\s+denegado\b | \binici(?:e|ar)\s+sesión\b | \b(?:active|habilite|permita)\b[^.\n]{0,30}\b(?:java\s*script|cookies|scripts)\b | \bintént?e(?:lo)?\b[^.\n]{0,20}\b(?:nuevo|tarde)\b | \bno\s+(?:está\s+)?disponible\b | \bha\s+ocurrido\s+un\s+error\b | \bvuelva\s+a\s+intentar\b | \bsesión\b[^.\n]{0,20}\bcaduc\w+
  | \bpage\b[^.\n]{0,30}\b(?:introuvable|inexistante|indisponible)\b | \bintrouvable\b | \baccès\s+(?:refusé|interdit|non)\b | \bconnectez[- ]vous\b | \b(?:activez|veuillez\s+activer|autorisez)\b | \bréessayez\b | \bveuillez\s+(?:patienter|réessayer|vous\s+connecter)\b | \b(?:temporairement|momentanément)\s+indisponible\b | \bune\s+erreur\b[^.\n]{0,20}\bsurvenue\b | \bsession\s+a\s+expiré\b
    """,
    re.I | re.X | re.M,
)
#: Short furniture around a notice: navigation, buttons, separators, server names.
FURNITURE = re.compile(
    r"^\W*(?:back\s+to\b.{0,40}|home\b.{0,60}|help|docs?|menu|search|skip\s+to.{0,30}|retry|reload|continue|sign\s+in|log\s+in|cancel|ok|close|zurück.{0,30}|volver.{0,30}|retour.{0,30}|[\w.-]+/\d[\w.]*|[-=*_~#|. ]*|©.{0,60}|powered\s+by.{0,40})\W*$",
    re.I,
)
_CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`|\"[^\"\n]{0,160}\"|“[^”\n]{0,160}”|«[^»\n]{0,160}»")
_TAG = re.compile(r"</?(?:html|head|title|body|h[1-6]|hr|p|div|span|center|br|a|b|i|em|strong|meta|script|style|ul|li|pre)\b[^>]*>", re.I)
_SENT = re.compile(r"(?<=[.!?…])\s+(?=[\"'(\[<{$%A-ZÄÖÜÉÈÀÁÍÓÚÑ¡¿#])|\n+")
_WORD = re.compile(r"[^\W\d_]{2,}")


def units(body: str) -> list[str]:
    """Sentences and lines of a text, code blocks apart."""
    return [u.strip() for u in _SENT.split(body) if u and u.strip()]


# The words of the usual filler text.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis "
    "nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat "
    "nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
# What a program prints for a value that it does not have.
UNSET = re.compile(r"\b(?:undefined|NaN|null|None|nil)\b|\[object Object\]|\$!?\{[\w.]+\}")
# What tells a sentence that explains or reports from one that stands in for content.
EXPLAINS = re.compile(
    r"\b(?:when(?:ever)?|while|because|so\s+that|until|since\s+\d|such\s+as|see\s+how|on\s+purpose|otherwise|refuses|instead\s+of|caused\s+by|came\s+from|not\s+from|unless|"
    r"which|whose|are\s+counted|stand\s+for|lives\s+in|stored\s+in|we\s+(?:answer|show|return|saw|measured|decided|changed|fixed)|wenn|weil|damit|während|bis\s+zu|cuando|porque|para\s+que|lorsque|quand|parce|afin)\b"
    r"|\breturns?\s+`?\d{3}\b",
    re.I,
)


# Every wording in NOTICE and FILLER holds one of these; the automaton finds them first.
STEMS = [
    # word beginnings, each after a blank
    " found", " exist", " availab", " unavailab", " load", " reach", " resolv", " display", " can't", " cannot", " could", " no longer", " been moved", " moved permanently", " was moved", " gateway", " bad request",
    " internal server", " forbidden", " unauthori", " offline", " too many", " rate limit", " too long", " timed", " timeout", " time-out", " has expired", " session", " ended", " access", " permission",
    " rights", " allowed", " permitted", " authori", " sign ", " sign-", " sign in", " signin", " log in", " log-in", " login", " authenticat", " members", " subscri", " script", " javascript",
    " cookie", " browser", " robot", " captcha", " unusual", " try again", " try later", " retry", " please wait", " wait ", " redirect", " wrong", " occurred", " error", " http", " status", " maintenance", " raised",
    " nullref", " undefined", " traceback", " trace:", " stack", " failed", " request", " incident", " reference id", " reference number", " correlation", " ray ", " clear your", " sorry", " oops", " contact", " ask ", " checking",
    " verif", " was blocked", " published", " hosted", " served", " online", " nicht", " zugriff", " bitte", " vorübergehend", " derzeit", " zurzeit", " anmeld", " fehler", " skript", " wartung", " weitergeleitet",
    " sitzung", " página", " dirección", " encontr", " no encontr", " denegado", " sesión", " habilit", " permita", " intént", " inténte", " disponible", " ocurrido", " vuelva", " introuvable", " inexist",
    " indisponible", " accès", " connectez", " autoris", " activez", " réessay", " veuillez", " patienter", " survenue", " expiré", " rejected", " returned a", " rendered", " restricted", " taken", " needs a", " needs ", " go back",
    " go home", " back to", " retour", " zurück", " if this", " exceeded", " may have", " n'existe", " n’existe", " existe", " disabled", " shown", " article", " fiche", " déplac", " supprim", " movid", " eliminad", " borrad",
    " traslad", " verschob", " gelöscht", " entfernt", " umgezogen", " requires", " required", " turn on", " enable", " 400", " 401", " 403", " 404", " 405", " 408", " 410", " 429", " 500", " 501", " 502", " 503", " 504",
    # filler
    " lorem", " dolor", " consectetur", " sed do", " ut enim", " duis", " excepteur", " nostrud", " reprehenderit", " text here", " goes here", " go here", " tbd", " todo", " tba", " n/a", " na ", " na.", " fixme", " xxx", " replace this",
    " sample heading", " sample paragraph", " sample text", " sample title", " sample content", " placeholder", " coming soon", " construction", " check back", " to be ", " left blank", " stub", " nothing here", " hier steht", " platzhalter", " demnächst", " im aufbau", " texto", " próximamente",
    " construcción", " texte", " bientôt", " insert", " asdf", " qwer", " test test", " foo bar", " bla", " this page", " this section",
]


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for s in STEMS:
        a.add_word(s, 1)
    a.make_automaton()
    return a


_EDGE = re.compile(r"[^\w'’/:.-]+")
_STEMS: list = []
_MARKS = re.compile(r"[{}<>$%@\[#]|__")


def _stems() -> ahocorasick.Automaton:
    if not _STEMS:
        _STEMS.append(_automaton())
    return _STEMS[0]


_HEAD = re.compile(r"\s*(?:#{1,6}\s|<h[1-6]>)")


def judged(u: str) -> tuple[str, str, list[str]]:
    """What a unit is, without what it quotes, and its words in lower case.

    ``placeholder``, ``filler``, ``notice``, ``furniture``, ``heading`` or ``content``.  A unit that
    explains, or that holds few placeholders among many words, speaks of such things and is content.
    The costly patterns run only where a cheap sign asks for them.
    """
    bare = _INLINE.sub(" ", u) if "`" in u or '"' in u or "“" in u or "«" in u else u
    low = bare.lower()
    words = _WORD.findall(low)
    n = len(words)
    coded = "`" in u
    if _MARKS.search(bare):
        holes = len(PLACEHOLDER.findall(bare)) + len(PLACEHOLDER_CI.findall(bare))
        if holes:
            left = len(_WORD.findall(PLACEHOLDER_CI.sub(" ", PLACEHOLDER.sub(" ", bare))))
            if (holes >= 0.2 * left or not left) and not (holes < 0.34 * left and n >= 8 and (coded or EXPLAINS.search(bare))):
                return "placeholder", bare, words
    if n <= 9 and not coded:
        unset = len(UNSET.findall(bare))
        if unset and (unset >= 2 or n <= 4):
            return "placeholder", bare, words
    if n >= 4 and sum(w in LOREM for w in words) > 0.6 * n:
        return "filler", bare, words
    if next(_stems().iter(f" {_EDGE.sub(' ', low)} "), None) is not None:
        k = "filler" if FILLER.search(bare) else "notice" if NOTICE.search(bare) else None
        if k and not (n >= 8 and (coded or EXPLAINS.search(bare))):
            return k, bare, words
    if FURNITURE.match(u) or (n <= 3 and not u.startswith(("#", "-", "*"))):
        return "furniture", bare, words
    if _HEAD.match(u) or n <= 2:
        return "heading", bare, words
    return "content", bare, words


def kind_of(u: str) -> str:
    return judged(u)[0]


#: Slots per word, and how many at least, from which a text counts as unfilled whatever it says.
HOLE_SHARE, HOLES_LEAST = 0.08, 3
#: A text of this many words with no more different ones than this says nothing.
REPEATED_WORDS, FEW_WORDS = 6, 4
#: Detected words per word of content: at and above STRONG the text is a response, between WEAK and STRONG only
#: where several hosts serve its wording and its address is not answered.
STRONG, WEAK = 1.0, 0.4
#: Hosts, and titles, under which a wording counts as served in many places.
HOSTS, TITLES = 2, 3
#: Units of content up to which a text is low in information.
LIGHT_UNITS = 2

_LABELLED = re.compile(r"^\s*[\w ]{2,30}:\s*<[^<>\n]{2,60}>\s*$", re.M)
# a slot is a short name between marks; which marks is open, but they must come back
_SLOT = re.compile(
    r"(?P<a>\{\{|\{%|<%=?|<<|[$#]!?\{|\[\[|@@|%%|__|<|\{|\[|@|%|~|\^|\b[A-Z]{3,}\()\s*(?P<name>[A-Za-z](?:[\w .|:-]{0,58}?[A-Za-z0-9])?)\s*(?P<b>\}\}|%\}|%>|>>|\]\]|@@|%%|__|>|\}|\]|@|%|~|\^|\))"
)
_PAIRS = {"{{": "}}", "{%": "%}", "<%": "%>", "<%=": "%>", "<<": ">>", "${": "}", "#{": "}", "$!{": "}", "#!{": "}", "[[": "]]", "<": ">", "{": "}", "[": "]"}
_BLANK = re.compile(r"\?{3,}|(?<![\w_])_{3,}(?![\w_])|\b(?:undefined|NaN|null|None)\b|\[object Object\]|\$[A-Z_]{3,}\b|(?<![\w$])\$!?[a-z]\w*\.[a-z]\w*")


_BLANK_SIGNS = ("???", "___", "undefined", "NaN", "null", "None", "[object", "$")
_ANY_MARK = re.compile(r"[{}<>$%@\[#~^?]|__|\b(?:undefined|NaN|null|None)\b|[A-Z]{3,}\(")


def slots(body: str) -> int:
    """How many slots of a template the text holds: those of every pair of marks that comes back."""
    by: Counter = Counter()
    for m in _SLOT.finditer(body):
        a = m["a"]
        if m["b"] != (")" if a[-1] == "(" else _PAIRS.get(a, a)):
            continue
        at, end = m.start(), m.end()
        # a parameter of a path, a link, an e-mail, a tag of markup, or a name that runs on, is no slot
        if (at and (body[at - 1] == "/" or (a in "@%~^" and body[at - 1].isalnum()))) or (a in ("[", "[[") and body[end:end + 1] == "(") or (a in "@%~^" and body[end:end + 1].isalnum()):
            continue
        by[a] += 1
    return sum(n for n in by.values() if n >= HOLES_LEAST) + (len(_BLANK.findall(body)) if any(x in body for x in _BLANK_SIGNS) else 0)


_STOP = frozenset("the a an of to and or for in on at by with from is are was were be this that its it as der die das und ein eine la el los las de un una le les des et du".split())


def terms(s: str | None) -> set[str]:
    return {w.lower() for w in _WORD.findall(s or "") if w.lower() not in _STOP and len(w) > 2}


_MASK = re.compile(r"[^\W_]*\d[\w.]*|/[\w./-]+")


def _key(low: str, words: list[str], masked: set[str]) -> int:
    """The skeleton of a unit: its words in lower case, without numbers, code and paths, the terms of title and address alike."""
    if "/" in low:
        words = _WORD.findall(_MASK.sub(" ", low))
    return xxhash.xxh64_intdigest(" ".join(words) if masked.isdisjoint(words) else " ".join("t" if w in masked else w for w in words)) - (1 << 63)


def _says_little(body: str, n_units: int) -> bool:
    """Whether a text of several words or units has no more than a few different ones; most texts tell after a line."""
    said: set[str] = set()
    n = 0
    for m in _WORD.finditer(body):
        n += 1
        said.add(m[0].lower())
        if len(said) > FEW_WORDS:
            return False
    return n >= REPEATED_WORDS or n_units >= 3


def profile(text: str, title: str | None, slug: str | None) -> tuple[int, int, bool, bool, bool, list[int], list[int]]:
    """Words of notices, words of content, unfilled or empty of words, address answered, light, skeletons of the units of content, and of the wordings of notices."""
    body = _TAG.sub("\n", _CODE.sub("\n", text.replace("\r\n", "\n")))
    bad = good = 0
    all_units = units(body)
    t = terms(title) | terms(slug)
    head = (title or "").strip()
    bare_head = head.strip("#>*-= ")
    own: set[int] = set()
    served: set[int] = set()
    n_own = 0
    specific = answered = False
    for u in all_units:
        k, bare, words = judged(u)
        if k == "content":
            # quoted words are words too
            good += len(words) if bare is u else len(_WORD.findall(u))
            n_own += 1
            specific = specific or "`" in u
            own.add(_key(bare.lower() if "/" in bare else "", words, t))
            if t and not answered:
                line = u.strip("#>*-= ")
                if not head or not (line.startswith(bare_head) and len(line) < len(head) + 8):
                    answered = not t.isdisjoint(words if bare is u else terms(u))
        elif k in ("placeholder", "filler", "notice"):
            bad += max(1, len(words) if bare is u else len(_WORD.findall(u)))
            if k == "notice":
                m = NOTICE.search(bare)
                served.add(_key(m[0].lower(), _WORD.findall(m[0].lower()), t) if m else 0)
    holes = slots(body) if _ANY_MARK.search(body) else 0
    hollow = (
        (holes >= HOLES_LEAST and holes >= HOLE_SHARE * max(1, len(_WORD.findall(body))))
        or ("<" in body and len(_LABELLED.findall(body)) >= 2)
        or ("```" not in text and _says_little(body, len(all_units)))
    )
    light = 0 < n_own <= LIGHT_UNITS and not specific and "```" not in text
    return bad, good, hollow, answered, light, sorted(own), sorted(served)


_ROWS = "doc_id long, host string, title_key long, bad int, good int, hollow boolean, answered boolean, light boolean, own array<long>, served array<long>"


def residue_evidence(documents: DataFrame) -> DataFrame:
    """``doc_id, bad, good, hollow, answered, n_hosts, n_titles, n_rich, evidence, residue``: one row per document.

    ``answered`` tells whether a term of title or address comes back in what the body says.  For its most
    widely served wording ``n_hosts`` counts the hosts; ``n_titles`` the titles of its least served unit;
    ``n_rich`` the documents in which one of its units stands among others.  ``evidence`` is
    ``template`` (slots, filler, or no words), ``response`` (notices with host or term evidence) or
    ``served`` (no known wording; terms and hosts alone), null for content.

    Null texts give no row; an empty text, or one of white space, is no residue (nothing stands in for
    content).  Null titles and addresses are no evidence either way.  A repeated id gives a row each.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for d, r, t, ti, sl in zip(b["doc_id"], b["repo_uri"], b["text"], b["title"], b["slug"]):
                ti = ti if isinstance(ti, str) else None
                # a title that only opens the text is no address of its own
                own = "" if ti is None or t.lstrip().startswith(ti.strip()) and not t.lstrip().startswith("#") else ti.lower()
                key = _key(own, _WORD.findall(own), set())
                got.append((d, r if isinstance(r, str) else "", key, *profile(t, ti, sl if isinstance(sl, str) else None)))
            yield pd.DataFrame(got, columns=[c.split()[0] for c in _ROWS.split(", ")])

    slug = F.regexp_extract(F.coalesce("repo_uri", F.lit("")), r"([^/:]+)$", 1)
    texts = spread(documents.where(F.col("text").isNotNull()).select("doc_id", "text", "title", "repo_uri")).withColumn("slug", slug)
    # each text is read once: what is kept of it are numbers, under a key of its own as ids may repeat
    seen = Staging(documents.sparkSession, "residue").cut(
        texts.mapInPandas(look, _ROWS).withColumn("row", F.monotonically_increasing_id()), "evidence"
    )
    # how widely a wording is served; each task sends a unit once per host and title, however often it has it
    notice = seen.select("host", F.explode("served").alias("u")).groupBy("u", "host").agg(F.lit(1).alias("one")).groupBy("u").agg(F.count(F.lit(1)).alias("hosts"))
    spread_of = seen.where("bad > 0").select("row", F.explode("served").alias("u")).join(notice, "u").groupBy("row").agg(F.max("hosts").alias("n_hosts"))
    plain = seen.select("host", "title_key", "light", F.explode("own").alias("u")).groupBy("u", "host", "title_key").agg(
        F.count_if(~F.col("light")).alias("rich"), F.count_if("light").alias("alone")
    )
    by_title = plain.where("alone > 0").groupBy("u", "title_key").agg(F.lit(1).alias("one")).groupBy("u").agg(F.count(F.lit(1)).alias("titles"))
    by_host = plain.groupBy("u", "host").agg(F.sum("rich").alias("rich"), F.sum("alone").alias("alone")).groupBy("u").agg(
        F.sum("rich").alias("rich"), F.count_if(F.col("alone") > 0).alias("hosts")
    )
    standing = seen.where("light and bad = 0 and not hollow and not answered").select("row", F.explode("own").alias("u"))
    alone = standing.join(by_host.where(F.col("hosts") >= HOSTS), "u", "left").join(by_title, "u", "left").groupBy("row").agg(
        F.min(F.coalesce("hosts", F.lit(0))).alias("u_hosts"), F.min(F.coalesce("titles", F.lit(0))).alias("n_titles"), F.max("rich").alias("n_rich")
    )
    known = seen.join(spread_of, "row", "left").join(alone, "row", "left")
    bad, good, hosts = F.col("bad"), F.col("good"), F.coalesce("n_hosts", "u_hosts", F.lit(0))
    nothing_else = (good == 0) & (bad > 0)
    many = F.coalesce("n_hosts", F.lit(0)) >= HOSTS
    response = (bad > 0) & (
        ((bad >= F.lit(STRONG) * good) & (~F.col("answered") | many | nothing_else)) | ((bad >= F.lit(WEAK) * good) & ~F.col("answered") & many)
    )
    served = (F.col("u_hosts") >= HOSTS) & (F.col("n_titles") >= TITLES) & (F.col("n_rich") == 0)
    evidence = F.when(F.col("hollow"), "template").when(response, "response").when(served, "served")
    return known.select("doc_id", "bad", "good", "hollow", "answered", hosts.alias("n_hosts"), "n_titles", "n_rich", evidence.alias("evidence"), evidence.isNotNull().alias("residue"))


def residue(documents: DataFrame) -> DataFrame:
    """``doc_id`` of each document whose text is residue in place of content."""
    return residue_evidence(documents).where("residue").select("doc_id").distinct()

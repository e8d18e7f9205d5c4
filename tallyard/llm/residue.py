"""Problem 7: template residue, filler, error pages and script notices.

Values are cut into pieces (lines and sentences, mark-up stripped), and the pieces of all three columns are aligned: words
that many values share are a template's constants, and what lies between them (the record's own name and place, numbers,
links, rare words, unfilled variables) its slots. A value is residue when

1. a slot retains a variable's name (``VARIABLE``), a default such as lorem ipsum or ``undefined`` (``DEFAULT``) or a blank,
   that is a mask or run of digits in place of a telephone number (``BLANK``);
2. it holds a template whose slot mostly holds such content (``SLOT``);
3. it is a whole-page template repeated over unrelated sites (``PAGE``): a template most of whose values are that one page
   and nothing else, or whose pages never say anything of their record. Contents mix freely and name their company;
4. for names and telephones, it is a form without a number that unrelated sites have in common, or such a page (``PAGE``);
5. one of its pieces is worded like an error, a notice or a default (``PHRASE``): this reaches what is too rare to repeat.

``reason`` tells which of these found a value first. Text is read once, in one Arrow pass that leaves hashes behind; every
statistic is a share with a confidence bound, so it means the same at every size. Pages are counted once a site.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import lookup_join, materialise

#: Share of the values (and least number of them) a word must be in to be a constant of templates.
WORD_SHARE, WORD_LEAST = 0.0002, 20
#: Least share of a template's pages that are one whole page, and most that speak of their record (bounds of confidence).
PAGE_SHARE, OWN_SHARE = 0.3, 0.1
#: Most of a template's pieces that may themselves hold the record's name or place; rows a site may have of one.
OWN_PIECES, SITE_ROWS = 0.2, 5.0
#: Least share of a name's or telephone's rows that lie on sites of their own.
UNRELATED = 0.7
#: Sites that must share a form, and share of its slots that must hold residue for the others to be residue as well.
SUPPORT, SLOT_SHARE = 15, 0.8
#: Reasons, in the order in which they are looked for.
VARIABLE, DEFAULT, BLANK, SLOT, PAGE, PHRASE = "variable", "default", "blank", "slot", "page", "phrase"

FIELDS = ("description_en", "phone", "name_en")

# Names that templates give to their variables.
VARIABLES = (
    "name title company companyname brand vendor phone tel telephone mobile fax contact email mail address city country "
    "description desc profile summary about text content year date site page url website link logo first last user "
    "short long founded region slug customer firm business store shop product service ar en number no id value field placeholder"
).split()
_VARIABLE = r"(?:%s)" % "|".join(VARIABLES)
_IDENT = r"[A-Za-z_][A-Za-z0-9_]*(?:[.\-][A-Za-z0-9_]+)*(?:\([^()]*\))?(?:\s*\|\s*\w+)*"

#: Syntaxes of unfilled variables.
PLACEHOLDER = re.compile(
    "|".join(
        (
            rf"\{{\{{\{{?\s*{_IDENT}\s*\}}?\}}\}}",  # {{ x }}
            rf"[$#@]\{{\s*{_IDENT}\s*\}}",  # ${x} #{x}
            r"\{%.*?%\}|<%.*?%>|<\?(?:php|=).*?\?>",  # {% x %} <%= x %>
            rf"\[\[\s*{_IDENT}\s*\]\]",  # [[x]]
            rf"@@\s*{_IDENT}\s*@@",
            r"(?<![\w%])%[A-Za-z_][A-Za-z0-9_.]{2,}%(?!\w)",  # %NAME%
            r"(?<![A-Za-z0-9_])__[A-Za-z][A-Za-z0-9_.]*?__(?![A-Za-z0-9_])",
            r"\{[A-Za-z_][A-Za-z0-9_.]*[A-Za-z0-9_]\}",  # {x}
            rf"(?i:&lt;\s*{_IDENT}\s*&gt;)",
            rf"(?i:(?<![<\[])[<\[]\s*{_VARIABLE}(?:[ _.\-]*(?:{_VARIABLE}|\d+))*\s*[>\]])",  # [contact phone]
            r"%\(\w+\)[sd]|(?<![\w%])%[sd](?!\w)|\$\$\w+\$\$|~~\w+~~|\|\*\w+\*\||\*\|\w+\|\*",
            r"(?i:\bINSERT[ _](?:%s)\b)" % "|".join(VARIABLES),
        )
    )
)
_HTML_NAMES = re.compile(r"(?i)<\s*(?:title|address|text|summary|link|content|time|date|name)\s*>")

_SCRIPTING = r"(?:java\s?script|js|scripts?|scripting|cookies?|java)"
_THING = (
    r"(?:text|title|name|description|profile|summary|content|company|business|firm|phone|telephone|mobile|number|no\.?|"
    r"paragraph|heading|details?|info(?:rmation)?|bio|address|e-?mail|vendor|store|about)"
)
_THINGS = rf"(?:(?:the|a|an|your|our|short|brief|company|business|contact|new|something|about|of|phone|mobile)\s+)*{_THING}(?:\s+{_THING})*"
_HTTP = r"(?:400|401|402|403|404|405|406|408|409|410|413|414|418|419|422|423|429|430|431|451|500|501|502|503|504|505|508|509|511|520|521|522|523|524|525|526)"
_HTTP_TEXT = (
    r"(?:bad request|unauthori[sz]ed|payment required|forbidden|(?:page |file |resource )?not found|method not allowed|"
    r"not acceptable|request timeout|conflict|gone|page expired|too many requests|internal(?: server)? error|"
    r"not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|access denied|server error|"
    r"web server is down|connection timed out|unprocessable entity|error)"
)

# Words of filler and of programs that stand where content should be; joiners between them.
DEFAULTS = frozenset(
    """
    lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim
    minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure velit esse
    cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit laborum
    test tests testing asdf asdfg asdfgh qwerty qwertz zxcv foobar blah undefined null nan untitled
    """.split()
)
JOINERS = frozenset("in and at of tel phone mobile object ut et ad ex ea do non id qui est anim co ltd est company inc text".split())

#: What a whole piece looks like when it is an error message, a notice or filler. Pieces are lower case, without wrappers.
WHOLE = re.compile(
    "|".join(
        (
            # codes and messages of servers
            r"http[\s:/\-]*\d{3}\b.*",
            rf"(?:http(?:/\d\.\d)?\s*)?(?:error|status|err)[\s:\-#(]*\d{{3}}\b.*|{_HTTP}[\s:\-.,]*{_HTTP_TEXT}\b.*",
            rf"(?:error|oops|sorry|whoops)?[\s!:,.\-]*{_HTTP_TEXT}[.!]?",
            r"(?:an?\s+)?(?:unexpected|unknown|internal|fatal|server|application|database|critical|runtime)\s+(?:server\s+)?(?:error|exception)\b.*",
            r"(?:sorry|oops|whoops|error)[,!.:]*\s+(?:something|an? (?:\w+ )?error|the page|we |this page|page).*",
            r"(?:something went wrong|an? (?:\w+ )?error (?:has )?occurr?ed).*",
            r"(?:warning|notice|fatal error|parse error|deprecated|error|exception|traceback)\s*[:(].*(?:line \d+|variable|\.php|\.py|\.js|index|null|stack|exception|undefined|too many|please try|timeout|gone|unavailable|unauthorized|forbidden|bad|not found|denied|failed).*",
            r"(?:could not|cannot|can't|unable to|failed to) (?:connect|load|open|fetch|reach|find|establish|read|resolve|retrieve|get|display|render)\b.*",
            r"(?:database|db|sql|mysql|connection|request|query|network|server|fetch|load) (?:connection )?(?:error|failed|failure|refused|reset|timed out|timeout)\b.*",
            r"(?:the |this )?(?:page|profile|site|website|document|file|resource|link|listing|content)\b[^.;]{0,40}(?:you (?:are|were) (?:looking for|trying)|you requested|requested|cannot be found|can't be found|could not be found|was not found|not found|no longer (?:exists|available)|has been (?:moved|removed|deleted|suspended|disabled)|does not exist|doesn't exist|is (?:temporarily )?unavailable|not available|expired).*",
            r"page (?:not found|unavailable|expired|does not exist)\b.*",
            r"access (?:is |to [^.]{0,40} )?(?:was |has been )?(?:denied|forbidden|restricted)[.!]?(?:\s+you (?:do not|don't) have.*)?",
            r"(?:you (?:do not|don't) have|insufficient) (?:permissions?|access|rights?|privileges?).*",
            r"(?:your |the |this )?(?:session|token|login|link) (?:has |is )?(?:expired|timed out|ended|invalid)\b.*",
            r"(?:please )?(?:log|sign) ?in (?:again |first |required|to (?:see|view|continue|access)).*|login required.*",
            r"(?:checking|verifying|validating|we are checking) (?:your|the|that|if|you)\b.*(?:browser|human|connection|robot|bot|secure).*",
            r"checking your browser.*|just a moment\b.*|attention required\b.*|one moment,? please.*|please wait\b.*|ddos protection.*|verify (?:that )?you are (?:a )?human.*|are you (?:a )?(?:human|robot).*|i am not a robot.*",
            r"(?:this takes a few seconds|redirecting|you will be redirected|you are being redirected).*",
            r"(?:loading|wait)(?:[\s,.…\-]*(?:please wait|page|content|data|profile|contact|number|phone)?)*",
            r"(?:time ?out|timed out|request timed out|aborted|failed|error|server error|service unavailable|bad gateway|forbidden|unauthori[sz]ed)(?:[\s\-:(]*\(?\d*\)?)[.!]?",
            r"request failed\b.*|.*\bmod_security\b.*|.*\bstack trace\b.*|traceback \(most recent call last\).*",
            r"(?:site|website|page|store|server|account|domain)?\s*(?:is )?(?:under (?:construction|maintenance)|down for maintenance|has been suspended|suspended|for sale|coming soon|parked)\b.*",
            # scripts, cookies and the like are needed
            rf"(?=.*\b{_SCRIPTING}\b)(?:please |kindly |you (?:need|have) to |to \w+[^.]{{0,60}},? (?:please )?|(?:we|this|the|our)\b[^.]{{0,50}}\b|for [^.]{{0,50}},? |click [^.]{{0,40}}\(?)?(?:enable|enabling|turn(?:ing)? on|switch(?:ing)? on|activate|activating|allow(?:ing)?|accept|requires?|required|needs?|re-?enable|use)\b.*",
            rf"(?:please |your |the |this |sorry,? )?(?:\w+ )?{_SCRIPTING}(?: and {_SCRIPTING})? (?:is|are|seems?|appears?|must|needs?|has|have|not|was|were|support)\b.*\b(?:disabled|blocked|off|required|needed|enabled|on|unavailable|missing|not|supported)\b.*",
            rf"{_SCRIPTING} (?:disabled|required|needed|not enabled|blocked|is required|must be enabled)\b.*",
            rf".*\b(?:scripts?|java\s?script|js) (?:is |are )?(?:required|needed)\b\W*",
            rf"(?:your browser|this browser) (?:does not|doesn't|has|is|must|needs?)\b.*",
            # filler
            r"(?=.*\b(?:lorem|ipsum|dolor|amet|consectetur|adipiscing|elit|eiusmod|tempor|incididunt|labore|aliqua|veniam|nostrud|exercitation|ullamco|laboris|nisi|aliquip|commodo|consequat|aute|irure|velit|cillum|fugiat|pariatur|excepteur|occaecat|cupidatat|proident|mollit|laborum)\b)(?:lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|eiusmod|tempor|incididunt|labore|dolore|magna|aliqua|enim|minim|veniam|quis|nostrud|exercitation|ullamco|laboris|nisi|aliquip|commodo|consequat|duis|aute|irure|velit|esse|cillum|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|proident|sunt|culpa|officia|deserunt|mollit|anim|est|laborum|ut|et|ad|ex|ea|do|in|non|id|qui|co|ltd|company|inc|[\s.,;])+",
            r"(?:asdf\w*|qwert\w*|zxcv\w*|qaz(?:wsx)?|hjkl|fdsa|jkl|abc|abcd\w*|aaa+|xxx+|zzz+|blah|bla|foo|bar|foobar|test|testing|tests|text|sample|dummy|example|placeholder|filler|default|untitled|tbd|tba|todo)(?:[\s,.\-_/]+(?:asdf\w*|qwert\w*|zxcv\w*|hjkl|abc|xxx+|zzz+|blah|bla|foo|bar|test|testing|text|document|page|title|name|\d+))*",
            rf"(?:(?:this is )?(?:just )?(?:an? |some |the )?(?:test|sample|dummy|example|default|placeholder|demo|filler|your|standard|generic|mock|fake))\s+{_THINGS}(?:\s+(?:\d+|ltd|co|inc|llc|here|goes here|only|\(.*\)?|[a-z]))?(?:\s*[\-:(,].*)?(?:\s+(?:goes|comes|will (?:go|appear|be)|should go|to be) .*)?",
            rf"(?:enter|add|type|write|insert|put|provide|fill in|paste|describe|edit|update|change|replace|tell us)\s+(?:in\s+)?{_THINGS}(?:\s+(?:here|below|goes here|in this (?:field|box|area)))?(?:\s+about\s+.*)?(?:\s*\(.*\)?)?(?:\s+here)?",
            rf"(?:enter|add|type|write|insert|put)\s+(?:a |some |something |the |your |short |brief )+[^.;]{{0,50}}\bhere\b.*",
            rf"{_THINGS}\s+(?:goes here|here|comes here|to be added|to follow|will appear here|missing|coming soon|not (?:set|provided|available|found|specified|entered))",
            rf"{_THINGS}\s*\((?:english|arabic|en|ar|optional|required|max.*)\)?",
            r"name of (?:your|the) (?:business|company|firm)|(?:company|business|phone|mobile|telephone|contact|firm) (?:name|number|no\.?|title|description)|description|title",
            r"(?:test|sample|example|dummy|demo|default|my|your|new) (?:company|firm|business|vendor|shop|store|organi[sz]ation|corporation)(?:\s+(?:ltd|co|inc|llc|name|[a-z]|\d+))*",
            r".*\b(?:replace me|edit this|delete this text|replace this text|change me|change this|fill me in|click to edit|double[- ]click to edit|your text here|text goes here)\b.*",
            r"coming soon|no description(?: available)?|description not available|not available|n/a|n\.a\.|none|nil|-+|\?+|\.{3,}|_+|unknown",
            # residue of programs
            r"(?:undefined|null|nan|none|nil|true|false|void|\[object \w+\]|\(null\)|\(undefined\)|#n/a|#ref!|#value!|#name\?|object object|in|and|at|of|tel|mailto|[\s,;:.\-/|&])*(?:undefined|null|nan|\[object \w+\]|#n/a|#ref!|#value!|#name\?|object object)(?:undefined|null|nan|none|nil|\[object \w+\]|in|and|at|of|[\s,;:.\-/|&])*",
            # notices in other languages
            r".*(?:تفعيل|تشغيل|فعل|فعّل|تمكين|يتطلب|تفعّل).{0,30}(?:جافا|سكربت|سكريبت|الارتباط|البرامج النصية|كوكيز|javascript).*",
            r".*(?:جافا ?سكر[يب]?[بت]ت?|javascript).{0,30}(?:معطل|مطلوب|غير مفعل|متوقف).*",
            r"(?:عذرا[،,]?\s*)?(?:الصفحة|الملف|الموقع|المحتوى)(?: المطلوبة| المطلوب)?\s*(?:غير (?:موجود|متاح|متوفر)|لم يتم العثور|محظور|قيد).*",
            r"(?:حدث|حصل|وقع)?\s*(?:خطأ|خطا)\b.*|.*خطأ (?:في|غير متوقع|داخلي).*|انتهت (?:الجلسة|صلاحية).*|(?:تم رفض|رفض) (?:الوصول|الدخول).*|(?:جار[يٍ]?|جاري) التحميل.*|يرجى الانتظار.*|(?:الدخول|الوصول) (?:مرفوض|ممنوع).*",
            r"(?:أدخل|ادخل|اكتب|أضف|اضف|ضع)\b.*|.*\bهنا\W*$|نص (?:تجريبي|افتراضي|بديل|مؤقت).*|لوريم.*|(?:هذا )?(?:النص|نص) (?:هو )?مثال.*|(?:شركة|اسم|عنوان) (?:تجريبي|افتراضي|تجريبية|افتراضية).*",
            r"(?:bitte|veuillez|s'il vous pla[iî]t|por favor|lütfen|per favore)\b.*(?:javascript|cookies?).*|.*(?:javascript|cookies?).{0,40}(?:aktivieren|activer|activ[eé]|habilit|etkin|abilit|benötigt|erforderlich|nécessaire|necesari).*|.*(?:aktivieren|activer|activez|habilite|active|abilita|включите).{0,30}(?:javascript|cookies?).*",
            r"(?:seite nicht gefunden|page (?:non trouvée|introuvable)|página no encontrada|sayfa bulunamadı|pagina non trovata|страница не найдена|zugriff verweigert|accès refusé|acceso denegado|erişim engellendi|ошибка \d+|erreur \d+|fehler \d+|hata \d+).*",
        )
    ),
    re.S,
)

_TAG = re.compile(r"</?(?:p|h[1-6]|div|span|br|hr|b|i|strong|em|li|ul|ol|a|font|center|body|html)\b[^<>]*>", re.I)
_CUT = re.compile(r"\n+|(?<=[.!?؟])(?<!\bco\.)(?<!\bltd\.)(?<!\bno\.)(?<!\best\.)(?<!\bgrp\.)(?<!\bf[ac]ct\.)\s+(?=[^\s\d(])|\s[|»›]\s", re.I)
_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_LEAD = _BLANKS + ">*-•·([\"'«“:;,.|"
_TAIL = _BLANKS + "<*-•·)]\"'»”:;,.!…|"
_SIGNATURE = re.compile(r"\s*\(ref \w+\)\W*$|\s*(?:copyright|©|\(c\))\s*(?:©\s*)?(?:19|20)\d\d\W*$", re.I)
#: Signs without which there is no placeholder.
_SIGNS = re.compile(r"[{\[<%@_&$~*|]|(?i:insert)")
#: Words (or their first four letters) without one of which no piece is residual.
TRIGGERS = frozenset(
    """
    http error errors err status oops whoops sorry bad forbidden unauthorized unauthorised payment gone conflict expired
    takes connect load fetch reach establish resolve retrieve render
    warning notice fatal parse deprecated exception traceback could cannot unable failed fail denied aborted refused
    database sql mysql connection server gateway unavailable timeout timed time out found longer moved removed
    deleted suspended disabled exist exists requested looking session token log login sign checking verifying validating
    moment attention wait ddos human robot redirecting redirected loading construction maintenance coming sale parked
    went occurred occured mod stack many available expired allowed acceptable implemented unprocessable restricted
    permission permissions insufficient access right rights privilege privileges signin t trying link invalid ended db reset
    javascript java js script scripts scripting cookie cookies browser
    lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore aliqua veniam nostrud
    exercitation ullamco laboris nisi aliquip commodo consequat aute irure velit cillum fugiat pariatur excepteur occaecat
    cupidatat proident mollit laborum
    asdf qwer zxcv qaz qazw hjkl fdsa jkl abc abcd aaa aaaa xxx xxxx zzz zzzz blah bla foo bar foob test testing tests text
    sample dummy example placeholder filler default untitled tbd tba todo just some demo standard generic mock fake
    enter add type write insert put provide fill paste describe edit update change replace tell here below follow missing
    set specified entered english arabic en ar optional required name number title description my new click
    undefined null nan none nil object void ref value na n unknown your provided added max
    page nicht non sayfa pagina accès acceso zugriff erişim erreur fehler hata ошибка страница seite página
    """.split()
)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[^\W\d_]+")
#: A lead-in of page titles ("Home : x").
_TITLE_LEAD = re.compile(r"^(?:home|profile|companies|company|page|welcome|trade guide|شركة|الرئيسية)\s*[|:\-–]\s*", re.I)


def pieces(value: str, whole: bool = False, wanted=None) -> list[str]:
    """Lines and sentences of a value (or all of it) without mark-up, signatures and decoration.

    ``wanted``: a test on a piece's words; pieces that fail it are left out before they are cleaned.
    """
    t = _TAG.sub(" " if whole else "\n", value) if "<" in value else value
    out = []
    for part in [t] if whole else _CUT.split(t):
        if wanted and (words := _WORDS.findall(part.lower())) and not wanted(words):
            continue
        if "(" in part or "©" in part or "opyright" in part or "OPYRIGHT" in part:
            part = _SIGNATURE.sub("", part)
        part = " ".join(part.lstrip(_LEAD).rstrip(_TAIL).split())
        if part:
            out.append(part)
    return out


def _bare(piece: str) -> str:
    return _TITLE_LEAD.sub("", piece).lstrip(_LEAD).rstrip(_TAIL).lower()


def mask_phone(value: str) -> bool:
    """A number that is a mask, one digit repeated, or digits counted up or down."""
    t = value.strip()
    if re.fullmatch(r"[\s+()\-.\d]*(?:[xX#*_•?][\s+()\-.\d]*){3,}", t):
        return True
    digits = re.sub(r"\D", "", t)
    if re.sub(r"[\s+()\-.\d]", "", t) or len(digits) < 5:
        return False
    steps = {(int(b) - int(a)) % 10 for a, b in zip(digits, digits[1:])}
    return steps in ({0}, {1}, {9})


def placeholder(text: str) -> bool:
    m = PLACEHOLDER.search(text)
    while m and _HTML_NAMES.fullmatch(m[0]):
        m = PLACEHOLDER.search(text, m.end())
    return m is not None


def residual_piece(piece: str) -> bool:
    """Whether a whole piece is filler, residue, an error message or a notice."""
    return WHOLE.fullmatch(_bare(piece)) is not None


_TOKEN = re.compile(r"[^\s()'\"<>]*[./][^\s()'\"<>]*[^\W_][^\s()'\"<>]*|[^\W\d_]+|\d+")
_NUMBERED = re.compile(r"\d")


def template_of(piece: str, constants, own: frozenset[str] | set[str], around: frozenset[str] | set[str]) -> tuple[str, bool]:
    """Template of a piece, ``*`` and ``#`` for its slots, and whether it speaks of its record.

    ``own``: words that belong to the record alone; ``around``: words that go with them where they stand beside one.
    Pieces with fewer than two constants are kept literally, but for numbers, links and the record's own words; those
    that are nothing but slots wholly so, since they have nothing in common.
    """
    words = _TOKEN.findall(piece.lower())
    mine = [False] * len(words)
    owned = bool(own) and not own.isdisjoint(words)
    if owned:
        mine = [w in own for w in words]
        for i in range(1, len(words)):
            mine[i] = mine[i] or (mine[i - 1] and words[i] in around)
        for i in range(len(words) - 2, -1, -1):
            mine[i] = mine[i] or (mine[i + 1] and words[i] in around)
    align = sum(w in constants for w, m in zip(words, mine) if not m) >= 2
    out: list[str] = []
    for w, m in zip(words, mine):
        if m or "/" in w or "." in w:
            slot = "*"
        elif w.isdigit():
            slot = "*" if align else "#"
        elif align and w not in constants:
            slot = "*"
        else:
            out.append(w)
            continue
        if out and out[-1] in ("*", "#"):
            out[-1] = slot if out[-1] == slot else "*"
        else:
            out.append(slot)
    text = " ".join(out)
    return text if text.strip("*# ") else piece.lower(), owned


def filler(words: list[str]) -> bool:
    """Whether a whole piece consists of defaults and what joins them, or of one short word again and again."""
    held = DEFAULTS.intersection(words)
    if held and all(w in held or w in JOINERS for w in words):
        return True
    return len(words) > 2 and len(set(words)) == 1


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


#: Beginnings (four letters) of words typed to fill a field.
FILL_STARTS = frozenset("asdf qwer zxcv qazw xxxx zzzz aaaa abcd foob".split())


def judgeable(words: list[str]) -> bool:
    """Whether any word is a trigger, begins like a fill word or is in Arabic script."""
    if not TRIGGERS.isdisjoint(words):
        return True
    return any(w[0] > "\u05ff" and w[0] <= "\u06ff" for w in words) or not FILL_STARTS.isdisjoint([w[:4] for w in words])


#: Bits of a form's hash: the piece speaks of its record; one of its slots holds residue.
OWN, LEFT = 1, 2
_NUMBER = re.compile(r"(?:\d[\s().\-/]*){7,}")


class Reader:
    """Reads values for one worker: aligns their pieces and judges them, with a memory of those already seen."""

    def __init__(self, constants: set[str] | frozenset[str], phrases: bool = True) -> None:
        """``phrases``: whether wordings are looked for beside slots and repeated pages."""
        self.constants, self.phrases = constants, phrases
        self._seen: dict[str, bool] = {}

    def _judged(self, piece: str) -> bool:
        key = re.sub(r"\d+", "0", piece) if len(piece) < 200 else piece
        if key not in self._seen:
            if len(self._seen) > 100_000:
                self._seen.clear()
            self._seen[key] = residual_piece(piece)
        return self._seen[key]

    def worded(self, field: str, value: str) -> bool:
        """Whether a piece of a value is worded like an error, a notice or a default."""
        words = _WORDS.findall(value.lower())
        if field == "phone" and words:
            if WHOLE.fullmatch(re.sub(r"^(?:tel|phone|mobile|fax)\s*[:.]\s*", "", _bare(value.strip()))):
                return True
        if judgeable(words) or (not words and not any(map(str.isdigit, value))):
            parts = pieces(value, field != "description_en", judgeable)
            if any(self._judged(p) for p in parts):
                return True
            return len(parts) < 4 and "\n" in value and residual_piece(_SPACE.sub(" ", value.strip()))
        return False

    def read(
        self, field: str, value: str, name: str | None = None, place: str | None = None
    ) -> tuple[str | None, list[int], bool | None]:
        """Reason that the value gives by itself, the hashes of its templates (with the bits ``OWN`` and ``LEFT``), and
        whether it speaks of its record: null where the record's name has no words of its own.

        Telephones with a number have no templates: a form only says something where the number is missing.
        """
        whole = field != "description_en"
        variable = bool(_SIGNS.search(value)) and placeholder(value)
        reason = VARIABLE if variable else BLANK if field == "phone" and mask_phone(value) else None
        own: set[str] = set()
        around: set[str] = set()
        named = False
        if not whole:
            around = set(_WORDS.findall((name or "").lower()))
            own = {w for w in around if len(w) > 3 and w not in self.constants}
            named = bool(own)
            own |= {w for w in _WORDS.findall((place or "").lower()) if len(w) > 3}
        forms: list[int] = []
        for piece in pieces(value, whole):
            left = variable and _SIGNS.search(piece) and placeholder(piece)
            if left:
                piece = PLACEHOLDER.sub(" 0 ", piece)
            text, owned = template_of(piece, () if whole else self.constants, own, around)
            if not left and reason is None and filler(_WORDS.findall(piece.lower())):
                reason, left = DEFAULT, True
            forms.append((_hash(text) & ~3) | (OWN if owned else 0) | (LEFT if left else 0))
        if field == "phone" and _NUMBER.search(value) and reason is None:
            forms = []
        if reason is None and self.phrases and self.worded(field, value):
            reason = PHRASE
        speaks = any(h & OWN for h in forms)
        return reason, forms, speaks if named or speaks else None

    def residual(self, field: str, value: str) -> bool:
        """Whether a value is residue by itself, without what other rows say."""
        return self.read(field, value)[0] is not None


def frequent_words(values: DataFrame, share: float = WORD_SHARE) -> set[str]:
    """Words in at least ``share`` of the rows of ``values`` (column ``value``), never fewer than ``WORD_LEAST`` rows.

    They are at most the words of an average value divided by ``share``.
    """
    words = F.explode(F.array_distinct(F.split(F.lower(F.regexp_replace("value", r"[^\p{L}]+", " ")), " ")))
    counted = values.select(words.alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    least = max(WORD_LEAST, int(values.count() * share))
    return {r[0] for r in counted.filter((F.col("n") >= least) & (F.col("w") != "")).select("w").collect()}


def bound(part: Column, whole: Column, upper: bool = False, z: float = 1.64) -> Column:
    """Wilson's lower (or upper) bound of confidence of a share."""
    p = part / whole
    spread = z * F.sqrt(F.greatest(F.lit(0.0), p * (1 - p) / whole + z * z / 4 / whole / whole))
    middle = p + z * z / 2 / whole
    return (middle + spread if upper else middle - spread) / (1 + z * z / whole)


def read_listings(listings: DataFrame, key: str, fields: tuple[str, str, str], phrases: bool = True) -> DataFrame:
    """``pos, field_name, site, reason, page, forms, speaks``: of every value what :meth:`Reader.read` says, and a hash of
    its templates in order.

    ``site`` tells unrelated records apart: the host of the link, else the digits of the telephone; null without either.
    """
    spark = listings.sparkSession
    text, phone, name = fields
    every = [F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields]
    values = listings.select(F.explode(F.array(*every)).alias("v")).select("v.value").filter("value is not null")
    # names of places are slots, however often they are written
    places = listings.select(F.col("city").alias("value")).filter("value is not null") if "city" in listings.columns else None
    constants = frequent_words(values) - (frequent_words(places) if places is not None else set())
    constants = spark.sparkContext.broadcast(frozenset(constants))
    made: list[Reader] = []

    @F.arrow_udf("array<struct<field_name: string, reason: string, page: bigint, forms: array<bigint>, speaks: boolean>>")
    def read(texts: pa.Array, phones: pa.Array, names: pa.Array, places: pa.Array) -> pa.Array:
        if not made:
            made.append(Reader(constants.value, phrases))
        reader, out = made[0], []
        for t, p, n, c in zip(*(x.to_pylist() for x in (texts, phones, names, places))):
            row = []
            for role, field, value in zip(FIELDS, fields, (t, p, n)):
                if not value or value.isspace():
                    continue
                reason, forms, speaks = reader.read(role, value, n, c)
                if reason or forms:
                    page = _hash(",".join(str(h & ~3) for h in forms)) if len(forms) != 1 else forms[0] & ~3
                    row.append((field, reason, page - (1 << 63), [h - (1 << 63) for h in forms], speaks))
            out.append(row)
        kinds = {"field_name": pa.string(), "reason": pa.string(), "page": pa.int64(), "forms": pa.list_(pa.int64()), "speaks": pa.bool_()}
        return pa.array([[dict(zip(kinds, x)) for x in r] for r in out], pa.list_(pa.struct(list(kinds.items()))))

    place = F.col("city") if "city" in listings.columns else F.lit(None).cast("string")
    link = F.lower("website_url") if "website_url" in listings.columns else F.lit(None).cast("string")
    host = F.nullif(F.regexp_extract(link, r"^\s*(?:https?:)?(?://)?(?:www\.)?([^/\s:?#]+)", 1), F.lit(""))
    digits = F.regexp_replace(F.col(phone), r"\D+", "")
    site = F.xxhash64(F.coalesce(host, F.when(F.length(digits) >= 7, F.substring(digits, -9, 9))))
    known = host.isNotNull() | (F.length(digits) >= 7)
    rows = listings.select(F.col(key).alias("pos"), F.when(known, site).alias("site"), F.explode(read(text, phone, name, place)).alias("r"))
    return rows.select("pos", "site", "r.*")


def repeated_pages(read: DataFrame, fields: tuple[str, str, str] = FIELDS) -> DataFrame:
    """``field_name, page, n, reason``: the pages of :func:`read_listings` that hold a repeated or left-over template.

    Pages are counted once a site; sites and pages are hashes, and both counts combine on the map side.
    """
    text, phone, name = fields
    once = read.groupBy("field_name", "page", "site").agg(
        F.count(F.lit(1)).alias("rows"), F.max("forms").alias("forms"), F.max("speaks").alias("speaks")
    )
    here = F.col("site").isNotNull()
    pages = once.groupBy("field_name", "page").agg(
        F.count("site").alias("sites"),
        F.count_if(here & F.col("speaks").isNotNull()).alias("named"),
        F.count_if(here & F.col("speaks")).alias("speaking"),
        F.sum(F.when(here, F.col("rows"))).alias("known"),
        F.sum("rows").alias("n"),
        F.max("forms").alias("forms"),
    )
    pages = materialise(pages)
    left = F.exists("forms", lambda h: h.bitwiseAND(F.lit(LEFT)) != 0)  # judged by its slot; no evidence against the rest
    forms = pages.filter((F.col("field_name") == text) & (F.col("sites") > 0))
    forms = forms.withColumn("alike", F.when(~left, F.col("sites")).otherwise(0)).withColumn("named", F.when(~left, F.col("named")).otherwise(0))
    forms = forms.select("sites", "known", "named", "speaking", "alike", F.explode(F.array_distinct("forms")).alias("h"))
    bits = F.col("h").bitwiseAND(F.lit(3))
    weighed = forms.groupBy(F.col("h").bitwiseAND(F.lit(~3)).alias("h")).agg(
        F.sum("sites").alias("sites"),
        F.max("alike").alias("one_page"),
        F.sum("known").alias("known"),
        F.sum("named").alias("named"),
        F.sum(F.when(F.col("named") > 0, F.col("speaking")).otherwise(0)).alias("speaking"),
        F.sum(F.when(bits.bitwiseAND(F.lit(OWN)) != 0, F.col("sites")).otherwise(0)).alias("own"),
        F.sum(F.when(bits.bitwiseAND(F.lit(LEFT)) != 0, F.col("sites")).otherwise(0)).alias("left"),
    )
    sites = F.col("sites")
    silent = (F.col("named") > 0) & (bound(F.col("speaking"), F.greatest(F.lit(1), "named"), upper=True) <= OWN_SHARE)
    whole_page = (bound(F.col("one_page"), sites) >= PAGE_SHARE) | silent
    page = (F.col("own") <= OWN_PIECES * sites) & (F.col("known") <= SITE_ROWS * sites) & whole_page
    slot = F.col("left") >= SLOT_SHARE * sites
    judged = weighed.filter(sites >= SUPPORT).select("h", F.when(slot, SLOT).when(page, PAGE).alias("why")).filter("why is not null")
    # names and telephones: forms that sites without anything in common share, or that are pages of the text column
    short = pages.filter(F.col("field_name") != text)
    shared = short.filter((F.col("sites") >= SUPPORT) & (bound(F.col("sites"), F.col("known")) >= UNRELATED))
    telephone = shared.filter(F.col("field_name") == phone).select(F.col("page").alias("h"))
    whys = judged.union(telephone.select("h", F.lit(PAGE).alias("why"))).groupBy("h").agg(F.max("why").alias("why"))
    held = pages.select("field_name", "page", "n", F.explode("forms").alias("h")).withColumn("h", F.col("h").bitwiseAND(F.lit(~3)))
    found = held.join(whys, "h").select("field_name", "page", "n", "why")
    found = found.union(shared.select("field_name", "page", "n", F.lit(PAGE).alias("why")))
    return found.groupBy("field_name", "page").agg(F.max("n").alias("n"), F.max("why").alias("repeated"))


def residue_reasons(
    listings: DataFrame, key: str = "pos", fields: tuple[str, str, str] = FIELDS, phrases: bool = True, hot_rows: int = 200_000
) -> DataFrame:
    """``pos, field_name, reason`` of every residual value (see the module); ``fields``: text, telephone and name.

    Null and blank values are no case; texts are read whole; repeated rows give one row; an empty table gives none. Beside
    the three columns, ``website_url`` and ``city`` are read where the table has them.
    """
    read = materialise(read_listings(listings, key, fields, phrases))
    pages = materialise(repeated_pages(read, fields))
    joined = lookup_join(read.select("pos", "field_name", "page", "reason"), pages, ["field_name", "page"], "n", hot_rows, "left")
    by_itself = F.when(F.col("reason") != PHRASE, F.col("reason"))
    why = F.coalesce(by_itself, F.col("repeated"), F.col("reason"))
    found = joined.select("pos", "field_name", why.alias("reason")).filter("reason is not null")
    return found.groupBy("pos", "field_name").agg(F.min("reason").alias("reason"))


def find_residue(listings: DataFrame, key: str = "pos", fields: tuple[str, str, str] = FIELDS, phrases: bool = True) -> DataFrame:
    """``pos, field_name`` of every value that holds an unfilled placeholder or is filler, residue, an error or a notice.

    The edge cases are those of :func:`residue_reasons`.
    """
    return residue_reasons(listings, key, fields, phrases).select("pos", "field_name")

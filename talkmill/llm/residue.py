"""Template residue, filler, error messages and notices that stand where content should.

Each text is cut into lines and sentences; numbers, dates, addresses, placeholders and dummy Latin are masked and the
name of a player or page before a message is taken off, so that one message has one normalised hash wherever it occurs.
Hashes are grouped over different texts and sources; those that recur widely are messages if phrase or placeholder rules,
or words of messages in a short unit, class them so. What doesn't recur counts only by its form (a placeholder, dummy
Latin) or where a text is nothing but messages. Sentences that merely talk about a placeholder or an error don't match,
as the rules are about whole messages.
"""

from __future__ import annotations

import html
import itertools
import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from re import _constants as _ops
from re import _parser

import ahocorasick
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions.arrow import map_rows
from talkmill.operators.skew import lookup_join
from talkmill.session import cut, spread, table

#: A message in words counts if so many different texts of so many sources have it.
WIDE_DOCS, WIDE_SOURCES = 3, 2
#: Recurring messages that are sent to every task; more are joined by a shuffle instead.
MOST_WIDE = 1_000_000

# Forms of unfilled placeholders.
_NAME = r"[A-Za-z][\w.\- ]{0,40}?"
PLACEHOLDER = re.compile(
    r"\{\{\s*" + _NAME + r"\s*\}\}|\{%\s*" + _NAME + r"\s*%\}|<%=?\s*" + _NAME + r"\s*%>|[$#]\{\s*" + _NAME + r"\s*\}|\[\[\s*" + _NAME + r"\s*\]\]"
    r"|\$[A-Z][A-Z_.]{1,40}\$|%%\s*" + _NAME + r"\s*%%|@@\s*" + _NAME + r"\s*@@|\b__[A-Za-z][\w.]{0,40}?__\b|\bXX_[\w.]+?_XX\b"
    r"|\[\s*(?:insert|your|enter|add|todo)\b[^\[\]]{0,60}\]|<\s*[\w. ]{1,40} goes here\s*>|<\s*(?:insert|your|enter)\b[^<>]{0,60}>|\[\s*(?:title|name|first ?name|guest|guest ?name|host|host ?name|date|topic|episode|show|sponsor|summary|duration|author|company|link|url|email|text|description)\s*\]|\{\d\}|(?<![\w$#{\\])\{\s*[A-Za-z][\w.]{1,40}\s*\}(?!\})",
    re.I,
)
#: Words of a sentence that explains or quotes a notation rather than leaving it unfilled.
ABOUT = re.compile(
    r"\b(?:braces?|brackets?|notation|syntax|delimit\w*|shell|keystrokes?|in the template|the engine|variables?|we type|you type|i type|we write|you write|i write|they write|escaped?|literal\w*|swaps? it|is replaced by|stands? for|called|named|the marker|the token|"
    r"is used|are used|explain(?:ed|s)? (?:why|how|that|what)|said|says|sign|means?|as a joke|returns?|kept seeing|find out|aloud|whenever|the song|the book|the film|the phrase|the words?|the error|for example|such as|e\.g\.)\b",
    re.I,
)

# Words of dummy Latin.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat "
    "duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "augue risus dictum morbi lacus porta ornare nullam pulvinar egestas felis vitae ligula mattis".split()
)

#: Words of dummy Latin that stand in hardly any other text.
LATIN_RARE = ("augue", "risus", "pulvinar", "consectetur", "egestas", "ligula", "mattis")

# Messages as they stand after masking (# is any number). Each has, before its rule, strings of which most messages have one; those for the rest are read off the rule.
STRONG = [
    # Unwritten text and its instructions.
    ("text_here title_here caption_here description_here content_here summary_here name_here subtitle_here heading_here body_here notes_here note_here link_here goes_here in_here", r"(?:your|the|enter your|insert|add) (?:text|title|caption|description|content|summary|name)(?: goes)? here"), ("text_here title_here caption_here description_here content_here summary_here name_here subtitle_here heading_here body_here notes_here note_here link_here goes_here in_here", r"(?:subtitle|title|text|caption|description|content|summary|body|heading) (?:goes )?here"),
    ("enter_a enter_the enter_your enter_caption enter_title enter_description enter_text enter_name enter_subtitle", r"enter (?:a |the |your )?(?:caption|title|description|text|name|subtitle)"), ("replace_this", r"replace this (?:paragraph|text|line|sentence)\b.*"), ("delete_this", r"delete this (?:line|text|paragraph)\b.*"),
    ("sample dummy placeholder filler", r"(?:this is )?(?:sample|dummy|placeholder|filler) (?:text|show notes|notes|content|description|page|paragraph)\b(?: (?:placeholder|sample|dummy|filler) text| #)*"),
    ("no_description no_transcript no_summary no_note no_content no_text no_title without_description without_transcript without_summary without_note without_content without_text without_title", r"(?:no|without) (?:description|transcript|summary|notes?|content|text|title) (?:yet|available|provided)"), ("coming_soon to_follow pending description_missing transcript_missing summary_missing content_missing text_missing notes_missing details_missing tba tbd be_added", r"(?:description|transcript|summary|content|text|notes|details?):? (?:coming soon|to follow|pending|missing|to be added|tba|tbd)"),
    ("tbd tba tbc todo fixme n/a to_be_added to_be_announced to_be_written to_be_done to_be_decided to_be_confirmed xxx", r"(?:\w+ ){0,2}\w+: (?:tbd|tba|tbc|todo|fixme|n/a|to be (?:added|announced|written|done|decided|confirmed)|xxx+)"), ("tbd tba tbc fixme to_be_added to_be_announced coming_soon", r"(?:tbd|tba|tbc|fixme|to be added|to be announced|coming soon)"),
    ("todo fixme tbd", r"(?:todo|fixme|tbd)\b ?[:\-–—] ?.*"), ("asdf qwerty test_test foo_bar bar_foo foo_foo blah_blah test_foo test_asdf", r"(?:asdf|qwerty|test|foo|bar|blah)(?: (?:asdf|qwerty|test|foo|bar|blah))+\b.*"), ("please_ignore ignore_this", r"(?:please ignore|ignore this)(?: (?:test|message))?"), ("untitled unnamed", r"(?:untitled|unnamed)(?: (?:document|episode|page|draft))?"),
    # Values that were never there.
    ("object_object", r"(?:\[?object object\]?[, ]*)+"), ("undefined_undefined null_null nan_nan none_none", r".{0,40}\b(?:undefined undefined|null null|nan nan|none none)\b"), ("by_null by_undefined by_nan by_none", r"(?:\w+ ){0,4}by (?:null|undefined|nan|none)\b.{0,40}\b(?:null|undefined|nan|none)"), ("null undefined", r"(?:null|undefined)"),
    # Errors of programs and servers.
    ("traceback", r"traceback \(most recent call last\):?.*"), ("file_\"", r"file \"[^\"]*\", line #(?:, in .*)?"), ("error exception", r"(?:[a-z]+\.)*[a-z]*(?:error|exception): '?[\w.#]+'?"), ("error", r"(?:fatal |parse |runtime |uncaught )+error:? .*"), ("uncaught", r"uncaught [a-z]*error:? .*"), ("error:", r"(?:syntax|type|reference|value|key|index|name|attribute)error: .*"),
    ("not_found gateway server_error unavailable forbidden unauthorized bad_request too_many", r"(?:(?:http |error |status )*# )?(?:not found|bad gateway|internal server error|service (?:temporarily )?unavailable|forbidden: .{0,80}|unauthorized|gateway time-?out|bad request|too many requests)"), ("#_forbidden #_gone", r"(?:http |error |status )*# (?:forbidden|gone)"),
    ("error fehler erreur", r"(?:http )?(?:error|fehler|erreur|error code|code d'erreur|fehlercode|código de error)(?: code)?:? ?#(?:[-:]? ?#)*(?:[:\-–] .{0,80})?"), ("timed_out", r"gateway timed out\b.{0,40}"), ("database", r"error establishing a database connection\b.{0,40}|database (?:connection )?error\b.{0,40}"),
    ("be_found be_displayed be_loaded be_reached", r"(?:the )?(?:page|file|episode|item|video|document|resource|site)(?: (?:you (?:asked|are looking) for|you requested|requested))? (?:could not|cannot|can't|can not|couldn't) be (?:found|displayed|loaded|reached)\b(?: on this server)?"),
    ("exist", r"(?:that|this|the) (?:page|episode|video|item|show|recording) (?:does not|doesn't|no longer) exists?"), ("removed deleted taken gone private available", r"(?:this|the) (?:video|recording|episode|page|item|audio) (?:has been|was|is) (?:removed|deleted|taken down|gone|private|no longer available|unavailable|not available)\b(?: by .{0,40})?"),
    ("unavailable not_available", r"(?:video|audio|episode|recording|player|content|transcript) (?:is )?(?:unavailable|not available)"), ("available_in", r"(?:not|this (?:video|content|episode) is not) available in your (?:area|country|region)"), ("went_wrong", r"something went wrong"), ("right_back", r"we(?:'|’)ll be right back"),
    ("permission access_to", r"you (?:do not|don't) have (?:permission|access) to .{1,60}"), ("denied", r"(?:access|permission) denied"), ("expired", r"(?:your )?session (?:has )?expired"), ("sign_in log_in", r"please (?:sign|log) in(?: again| to continue)"), ("blocked", r"request blocked\b.{0,60}"), ("slow_down_and", r"slow down and (?:retry|try again)\b.{0,40}"),
    ("try_again retry", r"(?:please )?(?:try again|retry) (?:in|after) # ?(?:s|seconds|minutes|min|ms)?"), ("logged", r"incident # has been logged"), ("occurred occured", r"an? (?:unexpected |unknown |internal )?error (?:has )?occurr?ed\b.{0,60}"), ("not_responding too_busy server_is", r"(?:the )?server (?:is )?(?:unavailable|not responding|too busy)"), ("timed_out reset refused", r"(?:the )?connection (?:was )?(?:timed out|reset|refused)"),
    ("encontrada", r"(?:página|pagina) no encontrada"), ("disponible", r"(?:servidor|servicio|video|vídeo|página) no disponible"), ("gefunden", r"(?:seite|datei) (?:wurde )?nicht gefunden"), ("verfügbar erreichbar", r"(?:dienst|server|video|seite) (?:ist )?(?:vorübergehend )?nicht (?:verfügbar|erreichbar)"),
    ("serverfehler verweigert denegado refusé interno interne", r"(?:interner serverfehler|zugriff verweigert|acceso denegado|accès refusé|error interno del servidor|erreur interne du serveur)"), ("introuvable trouvée", r"page (?:introuvable|non trouvée)(?: [–-] erreur #)?(?: [–-] #)?"), ("disponible", r"(?:service|vidéo|serveur) (?:temporairement )?(?:indisponible|non disponible)"),
    # Notices from the page.
    ("javascript enable_script turn_on_script activate_script allow_script switch_on_script scripting cookies_and", r"(?:please |you (?:need|have|must)(?: to)? |this (?:page|site|app|player) (?:needs|requires) (?:you to )?)*(?:enable|turn on|activate|allow|switch on) (?:javascript|scripts?|scripting|cookies and javascript)\b(?: (?:to|and|in) .{0,50})?"), ("javascript requires_script needs_script", r"(?:this|the|our) (?:page|site|app|application|player|content|website) (?:requires|needs) (?:javascript|scripts?)\b(?: to .{0,40})?"),
    ("javascript script_is scripts_are", r"(?:javascript|scripts?) (?:is|are) (?:disabled|required|not enabled|switched off|turned off|blocked)\b.{0,60}"), ("your_browser", r"your browser (?:has (?:them|javascript|scripts?) (?:switched|turned) off|does not support .{1,40}|is (?:outdated|out of date|not supported))"), ("checking", r"checking (?:if the site connection|your browser|you are human)\b.{0,60}"),
    ("human", r"(?:verify|verifying|confirm) (?:that )?you are (?:a )?human\b.{0,40}"), ("captcha", r"(?:please )?complete the captcha\b.{0,40}"), ("javascript", r"(?:por favor,? )?(?:necesita |debe |tiene que )?(?:activar|active|habilite|habilitar|activa) (?:el )?javascript\b.{0,60}"), ("javascript", r"(?:bitte )?aktivieren sie (?:bitte )?javascript\b.{0,60}"),
    ("javascript", r"javascript (?:est|ist|está) (?:désactivé|deaktiviert|desactivado|erforderlich|requis|necesario)"), ("activer", r"(?:veuillez |merci de )(?:l['’ ]?|le |d['’])?activer\b.{0,60}"),
    # The same in other words and languages.
    ("text_here title_here caption_here description_here content_here summary_here name_here subtitle_here heading_here body_here notes_here note_here link_here goes_here in_here", r"(?:type|insert|add|write|put|paste) (?:your |the |a |some )?(?:text|title|caption|description|content|summary|name|notes?|link) (?:in )?here"), ("to_edit", r"click (?:here )?to edit(?: .{0,30})?"), ("default_text edit_this filled_in fill_in", r"default text|edit this (?:text|page|paragraph)\b.{0,40}|to be filled in\b.{0,30}|(?:please )?fill in (?:the|this) (?:title|text|description|field)\b.{0,30}"),
    ("xxxx", r"x{4,}(?: x{3,})*"), ("%s %d", r"(?:[\w ]{0,20}: ?)?%[sd](?:[ ,]+%[sd])*"),
    ("javascript with_script if_script scripts_must script_must without_script", r"(?:this|the|our) (?:page|site|app|application|player|content|website) (?:works|runs|loads) (?:best|only) (?:with|if) (?:javascript|scripts?)\b.{0,40}|(?:javascript|scripts?) must be (?:enabled|turned on|switched on|allowed)\b.{0,60}|without (?:javascript|scripts?),? (?:this|the) (?:page|site|app|player) .{0,60}"), ("noscript", r"<?noscript>?.{0,60}"),
    ("javascript", r"(?:diese|die) (?:seite|anwendung|app) (?:benötigt|braucht|erfordert) javascript\b.{0,40}|javascript muss aktiviert (?:sein|werden)\b.{0,40}|ce (?:site|lecteur) (?:nécessite|requiert) javascript\b.{0,40}|(?:esta|este) (?:página|sitio|aplicación) (?:necesita|requiere) javascript\b.{0,40}|(?:ative|active|habilite) o javascript\b.{0,60}"),
    ("robot unusual_traffic", r"(?:confirm |prove |verify )?(?:that )?(?:you(?:'re| are)|i am|i'm|are you) (?:not )?a (?:robot|bot)\b.{0,30}|(?:we have )?detected unusual traffic\b.{0,60}"), ("broke_on our_end our_side", r"(?:sorry, ?|oops[,!]? ?)?something (?:went wrong|broke) on our (?:end|side)\b.{0,40}"),
    ("while_processing while_loading when_loading your_request", r"(?:there was )?an? (?:error|problem) (?:occurred )?(?:while|when) (?:processing|loading|handling) (?:your request|the page|this page)\b.{0,30}"), ("isn't_working isn’t_working not_working maintenance", r"(?:this|the) (?:page|site|server) (?:isn't|is not|isn’t) working\b.{0,40}|(?:(?:this|the|our) (?:site|page|server|service) is )?(?:currently |temporarily )?(?:down for|under|undergoing) (?:scheduled )?maintenance\b.{0,60}"),
    ("timed_out timeout was_refused was_reset", r"(?:the )?(?:request|connection|operation|session|upstream request) (?:has )?(?:timed out|timeout|was refused|was reset)\b.{0,40}|(?:upstream )?(?:request|read|connect(?:ion)?) timeout\b.{0,30}"), ("limit_exceeded limit_reached quota_exceeded", r"(?:rate|request|usage|quota) limit (?:exceeded|reached)\b.{0,40}|quota exceeded\b.{0,30}"),
    ("terminated suspended deactivated private no_longer", r"(?:this|the) (?:account|channel|user|video|episode|recording|content) (?:has been|was|is) (?:terminated|suspended|deactivated|blocked|private|made private|no longer available)\b.{0,60}"), ("login_required log-in_required sign-in_required registration_required login_is sign-in_is", r"(?:login|log-in|sign-in|registration) (?:is )?required\b.{0,40}"),
    ("unexpected_token unexpected_end is_not_defined not_a_function", r"(?:\w*error: )?unexpected (?:token|end of)\b.{0,80}|(?:\w*error: )?[\w.$']{1,40} is not (?:defined|a function)\b.{0,60}"), ("segmentation panic: in_thread stack_trace stacktrace sqlstate no_such_file", r"segmentation fault\b.{0,30}|panic: .{0,100}|exception in thread (?:[\"'].*|.{0,120})|(?:full )?stack ?trace:?(?: ?#.*|.{0,60})|sqlstate(?: ?[\[(:#].*|.{0,120})|(?:[\w/.#]+: )?no such file or directory\b.{0,60}"), ("error\" errors\" exception\"", r"\{ ?(?:\"(?:status|statuscode|status_code|code|timestamp|success|ok|message|type|title|path)\" ?:[^{}]*)?\"(?:errors?|exception)\" ?: ?(?!null|false|none|\"\"|\[\]|\{\}).*"), ("on_line", r"(?:php )?(?:warning|notice|deprecated): .{0,120} on line #"),
    ("fehler sitzung wartung", r"(?:interner )?(?:server)?fehler:? #(?: .{0,40})?|ein fehler ist aufgetreten.{0,40}|(?:die |ihre )?sitzung (?:ist )?abgelaufen.{0,30}|(?:wegen )?wartung(?:sarbeiten)? .{0,40}nicht (?:verfügbar|erreichbar).{0,20}"), ("sesión un_error", r"(?:su |la )?sesión ha (?:caducado|expirado).{0,30}|(?:ha ocurrido|se ha producido) un error.{0,40}"), ("expiré erreur", r"(?:votre |la )?session (?:a |est )?expirée?.{0,30}|une erreur (?:est|s'est) (?:survenue|produite).{0,40}"),
    ("não_encontrad indisponível não_disponível", r"(?:página|arquivo|vídeo|episódio) (?:não (?:encontrad[ao]|disponível)|indisponível)|serviço (?:temporariamente )?indisponível"), ("не_найдена ошибка недоступ запрещ включите", r"страница не найдена.{0,30}|ошибка #.{0,40}|(?:видео|сервис|страница|сервер)(?: временно)? недоступ\w+.{0,30}|доступ запрещ[её]н.{0,30}|(?:пожалуйста, )?включите javascript.{0,60}"),
    ("見つかりません 存在しません 利用できません 再生できません エラー javascript", r"(?:お探しの)?(?:ページ|ファイル|動画)(?:が|は)(?:見つかりません(?:でした)?|存在しません|利用できません|再生できません).{0,20}|エラーが発生しました.{0,20}|.{0,10}javascript(?:を|が)(?:有効に|無効).{0,30}"), ("找不到 未找到 不存在 不可用 无法显示 错误 javascript", r"(?:找不到|未找到)(?:该)?(?:页面|文件|视频).{0,20}|(?:页面|视频|文件)(?:不存在|不可用|无法显示|未找到).{0,20}|(?:服务器|发生)?(?:内部)?错误 ?#?.{0,20}|请(?:启用|开启|打开) ?javascript.{0,30}"),
    ("خطأ غير_موجود غير_متاح غير_متوفر تفعيل", r"(?:الصفحة|الملف|الفيديو) غير (?:موجود|متاح|متوفر)ة?.{0,30}|خطأ #.{0,30}|(?:يرجى|الرجاء) تفعيل (?:javascript|جافا ?سكريبت).{0,40}"), ("त्रुटि पृष्ठ javascript", r"पृष्ठ (?:नहीं मिला|उपलब्ध नहीं).{0,30}|त्रुटि #.{0,30}|कृपया javascript (?:सक्षम|चालू) करें.{0,40}"),
    ("not_found", r"(?:page|file|episode|video|item|document|resource|url)(?: was)? not found(?: on this server)?|the requested (?:url|page|resource|file)(?: .{1,60})? (?:was not found|could not be found|does not exist)\b.{0,40}|no (?:results|episodes?|transcripts?|items?) (?:were |was )?found"), ("could_not_find couldn't_find", r"we (?:could not|couldn't|can't|cannot) find (?:that|this|the) (?:page|episode|video|item|file)\b.{0,40}"),
    ("been_blocked been_denied", r"(?:you have|you've|access to this (?:page|site|server) has) been (?:blocked|denied|limited)\b.{0,60}"), ("human", r"please (?:verify|confirm|prove) (?:that )?you are (?:a )?human\b.{0,40}"), ("javascript scripts_on", r"(?:please )?(?:turn|switch) (?:javascript|scripts) on\b.{0,60}"),
    ("placeholder dummy", r"this is (?:a |just a |only a )?(?:placeholder|dummy|filler)(?: text| page| episode)?"), ("construction", r"(?:(?:this|our) (?:page|site) is )?under construction"), ("goes_here", r"(?:[\w'-]+ ){1,4}goes here"), ("translation_missing missing_translation", r"(?:translation missing|missing translation):? .{0,60}"),
    ("cannot_get", r"cannot (?:get|post) /.{0,80}"), ("reset_by", r"connection (?:was )?(?:reset|closed) by peer\b.{0,30}"), ("proxy_error internal_error server_error", r"proxy error|(?:the )?(?:server|application) (?:has )?encountered an (?:internal |unexpected )?error\b.{0,60}|(?:internal |unknown )?(?:server|application) error\b.{0,20}"), ("invalid_request bad_request", r"(?:invalid|bad|malformed) request"), ("err_", r"err_[a-z_]{4,40}"),
]
# What may also be said in content; counts only where it recurs widely or beside a message of the rules above.
WEAK = [
    ("oops error loading please_wait a_moment", r"(?:oops|error|loading|please wait|just a moment)"), ("try_again retry", r"(?:please )?(?:try again|retry)(?: later)?"), ("#", r"[(\[]?(?:request|ref\.?|ray|build|vorgang|código|node|incident|reference|block|slot|trace|code|id|error)?(?: id)?[: ]* ?#(?:[-.]#)*[)\]]?"),
    ("proxy", r"proxy/#(?:\.#)*"), ("not_found forbidden", r"(?:not found|forbidden)"), ("with_guest", r"with guest"),
]

# Words that stand in messages and in hardly any talk. A short unit with one of them, and none of those that tell a story, counts where it recurs widely.
LIKELY = (
    "javascript noscript browser unavailable forbidden unauthorized expired timeout timed_out maintenance captcha placeholder untitled undefined http:// error exception not_found denied permission reload refresh try_again retry uncaught traceback "
    "fehler erreur introuvable indisponible nicht_gefunden nicht_verfügbar no_encontrad no_disponible não_encontrad indisponível ошибка недоступ не_найден エラー 見つかりません 错误 找不到 خطأ त्रुटि"
)
_STORY = re.compile(r"\b(?:i|we|he|she|they|us|our|ours|my|me|his|her|somebody|nobody|said|says|told|asked|wrote|saw|heard|laughed|because|yesterday|weeks?|years?)\b")

_LEAD = re.compile(r"(?:[^\s:|–—]+ ){0,3}?[^\s:|–—]+ ?(?:::|[:|–—-]) ")  # a player's or a page's name before the message
_LIKELY = re.compile("|".join(re.escape(c.replace("_", " ")) if not c.isascii() or "_" in c else rf"\b{re.escape(c)}" for c in LIKELY.split()))
_SORRY = re.compile(r"(?:(?:sorry|oops|whoops|uh-oh|error|notice|warning|attention)[,!:.… –-]+)+")
_BETWEEN = re.compile(r"[\s.!?…:;,|–—()\[\]*\"'«»-]*")


#: Strings that a part of a rule is spelled out into at most; a part with more is cut in two.
SPELLED = 256


def _best(sets: list[set[str]], cues: list[str]) -> set[str] | None:
    """Of sets of strings of which a match has one each, the one that the written cues cover best, else the one of the longest strings."""
    # A mask stands for something else in the text, so only what is between masks can be looked for.
    cut = [{max(x.split("#"), key=lambda y: (any(c in y for c in cues), len(y.strip()))).strip() for x in s} for s in sets]
    return max((s for s in cut if s and "" not in s), key=lambda s: (all(any(c in x for c in cues) for x in s), min(map(len, s)), -len(s)), default=None)


def _required(nodes: Iterable, cues: list[str]) -> tuple[set[str] | None, set[str] | None]:
    """(all strings that the parsed rule matches if they are few, else None; strings of which any match has at least one, or None)."""
    whole, run, sets = True, {""}, []
    for op, arg in nodes:
        exact, need, more = None, None, False
        if op is _ops.LITERAL:
            exact = {chr(arg)}
        elif op is _ops.IN and all(o is _ops.LITERAL for o, _ in arg):
            exact = {chr(a) for _, a in arg}
        elif op in (_ops.AT, _ops.ASSERT, _ops.ASSERT_NOT):
            exact = {""}
        elif op is _ops.SUBPATTERN:
            exact, need = _required(arg[3], cues)
        elif op is _ops.BRANCH:
            parts = [_required(x, cues) for x in arg[1]]
            exact = set().union(*(e for e, _ in parts)) if all(e is not None for e, _ in parts) else None
            needs = [n if e is None else _best([e], cues) for e, n in parts]
            need = set().union(*needs) if all(needs) else None
        elif op in (_ops.MAX_REPEAT, _ops.MIN_REPEAT):
            least, most, inner = arg
            e, n = _required(inner, cues)
            if e is not None and most == 1:
                exact = e | {""}
            elif least and e is not None and len(e) ** least <= SPELLED:
                exact, more = {"".join(x) for x in itertools.product(e, repeat=least)}, most > least
            elif least:
                need = n if e is None else _best([e], cues)
        if exact is not None and len(exact) > SPELLED:
            exact, need = None, _best([exact], cues)
        if exact is not None and len(run) * len(exact) <= SPELLED:
            run = {a + b for a in run for b in exact}
            if more:  # what follows stands after further turns
                whole, sets, run = False, [*sets, run], {""}
            continue
        whole = False
        sets += [run, *([need] if need else []), *([exact] if more else [])]
        run = exact if exact is not None and not more else {""}
    return (run if whole else None), _best([*sets, run], cues)


def _cover(cues: list[str], rule: str) -> list[str]:
    """``cues`` with what is missing for each match of ``rule`` to have one; a rule of nothing but a number has only its mask."""
    written = [x for c in cues if (x := c.replace("#", "").strip())]
    exact, need = _required(_parser.parse(rule), written)
    if exact is not None:
        need = _best([exact], written)
    if need is None and "#" not in cues:
        raise ValueError(f"no cue can be told for {rule}")
    missing = {x for x in need or () if not any(c in x for c in written)}
    return cues + sorted(x for x in missing if not any(y in x for y in missing - {x}))


def _rules(rows: list[tuple[str, str]]) -> list[tuple[list[str], re.Pattern]]:
    return [(_cover([c.replace("_", " ") for c in cues.split()], rule), re.compile(rf"(?:{rule})(?![\w])")) for cues, rule in rows]


_RULES = {"strong": _rules(STRONG), "weak": _rules(WEAK)}


def _automaton() -> ahocorasick.Automaton:
    """Finds in one pass which cues a text has: of the rules, of placeholders and of dummy Latin."""
    a = ahocorasick.Automaton()
    by_cue: dict[str, list[tuple[str, re.Pattern]]] = {}
    for kind, rows in _RULES.items():
        for cues, rule in rows:
            for c in cues:
                by_cue.setdefault("" if c == "#" else re.sub("[#]", "", c).strip(), []).append((kind, rule))
    for c in [*"{}[]<>$%@", "xx_", "__", "lorem", "ipsum", *LATIN_RARE]:
        by_cue.setdefault(c, [])
    always = by_cue.pop("", [])
    for c in LIKELY.split():
        by_cue.setdefault(c.replace("_", " "), [])
    for c, rules in by_cue.items():
        a.add_word(c, rules + always)
    a.make_automaton()
    return a


_CUES = _automaton()
_LIKELY_CUES = ahocorasick.Automaton()
for _c in LIKELY.split():
    _LIKELY_CUES.add_word(_c.replace("_", " "), True)
_LIKELY_CUES.make_automaton()


def has_cue(text: str) -> bool:
    return next(_CUES.iter(text.lower()), None) is not None


_ADDRESS = re.compile(r"(?:https?://|www\.)\S+|[\w.+-]+@[\w-]+\.[\w.-]+")
_TAG = re.compile(r"</?(?:p|div|span|h[1-6]|li|ul|ol|a|b|i|em|strong|br|td|tr|table|section|main|body|html|pre|code|article|header|footer)\b[^<>]*>", re.I)
_HIDDEN = re.compile("[​-‏⁠﻿­‪-‮]")
_OPEN = re.compile(r"[{\[<$%@]|[xX]{2}_|__")
_NUMBER = re.compile(r"\d+(?:[.,:/-]\d+)*")
_SPLIT = re.compile(r"(?<=[.!?。！？])\s+|(?<=</p>)|(?<=</h\d>)|(?<=</div>)", re.I)
_LATIN_CUE = re.compile("|".join(("lorem", "ipsum", *LATIN_RARE)))
_PH = "⟦⟧"
# A placeholder that says or explains something stands for a name; the verb isn't about the placeholder.
_ACTS = re.compile(rf"{_PH},? (?:also |then |now )?(?:explain(?:ed|s)?(?: why| how| that| what)?|sa(?:id|ys)(?! aloud))\b")
_LATIN_RUN = re.compile(rf"\b(?:{'|'.join(sorted(LATIN))})\b(?:[\s.,;:]+(?:{'|'.join(sorted(LATIN))})\b){{3,}}[.,;:]?")


def normal(text: str) -> str:
    """``text`` without escapes, compatibility forms and invisible characters."""
    return _HIDDEN.sub("", unicodedata.normalize("NFKC", html.unescape(text)))


def units(text: str | None) -> list[str]:
    """The lines and, within them, the sentences of a text, without tags and invisible characters, spaced evenly."""
    out = []
    for line in normal(text or "").splitlines():
        for part in _SPLIT.split(line):
            if part := " ".join(_TAG.sub(" ", part).split()):
                out.append(part)
    return out


def masked(unit: str) -> str:
    """``unit`` with placeholders, addresses and numbers masked, in lower case."""
    if _OPEN.search(unit):
        unit = PLACEHOLDER.sub(_PH, unit)
    if "@" in unit or "://" in unit or "www." in unit:
        unit = _ADDRESS.sub("⟨⟩", unit)
    return _NUMBER.sub("#", unit).lower()


def message_kind(unit: str) -> str | None:
    """``strong``, ``weak``, ``likely`` or None for one unit of a text; the latter two count where they recur widely."""
    return _kind(unit) if len(unit) <= 400 else _kind.__wrapped__(unit)


@lru_cache(maxsize=50_000)
def _kind(unit: str) -> str | None:
    m = masked(unit)
    if _PH in m:
        if re.fullmatch(rf"[\s|,:–—-]*(?:[\w ]{{0,30}}[:|,–—-]? ?{_PH}[\s|,.!–—-]*+)+", m) or not ABOUT.search(_ACTS.sub(_PH, m)):
            return "strong"
        return None
    if _LATIN_CUE.search(m):
        run = most = latin = 0
        words = re.findall(r"[^\W\d_]+", m)
        for w in words:
            run = run + 1 if w in LATIN else 0
            latin += w in LATIN
            most = max(most, run)
        if most >= 6 or latin >= 0.6 * len(words):
            return "strong"
    return _spelled_out(m) or ("likely" if next(_LIKELY_CUES.iter(m), None) and len(m.split()) <= 16 and _LIKELY.search(m) and not _STORY.search(m) and not ABOUT.search(m) else None)


def _spelled_out(m: str) -> str | None:
    """The kind of a masked unit that consists of messages, with at most a name before them."""
    found = {rule: kind for _, rules in _CUES.iter(m) for kind, rule in rules}
    rules = {k: [r for r, kind in found.items() if kind == k] for k in _RULES}
    rules["weak"] += [r for cues, r in _RULES["weak"] if "#" in cues]
    lead = _LEAD.match(m)
    sorry = _SORRY.match(m, lead.end() if lead else 0)
    for start in {0, lead.end() if lead else 0, sorry.end() if sorry else 0}:
        at, kind = _BETWEEN.match(m, start).end(), "weak"
        while at < len(m):
            for k in ("strong", "weak"):
                ends = [x.end() for r in rules[k] if (x := r.match(m, at))]
                if ends and max(ends) > at:
                    at, kind = _BETWEEN.match(m, max(ends)).end(), "strong" if k == "strong" else kind
                    break
            else:
                break
        if at >= len(m):  # a bare number says nothing
            return kind if kind == "strong" or re.search(r"[^\W\d_]", m) else None
    return None


def group_text(unit: str) -> str:
    """What a unit is grouped by: masked, a run of dummy Latin to one mask, without the name of a player or page before it."""
    m = masked(unit)
    if _LATIN_CUE.search(m):
        m = _LATIN_RUN.sub("◇", m)
    lead = _LEAD.match(m)
    return m[lead.end() :] if lead else m


def text_messages(text: str | None) -> tuple[dict[int, tuple[str, bool]], bool]:
    """The messages of a text, by hash the kind and whether it counts by itself, and whether the text has nothing else.

    Placeholders and dummy Latin count by their form. A message in words counts by itself only where the text has
    nothing but such; beside other text it has to recur.
    """
    if not text or not has_cue(" ".join(normal(text).split())):
        return {}, False
    found: dict[int, tuple[str, bool]] = {}
    whole = only = True
    for u in units(text):
        kind = message_kind(u) if has_cue(u) else None
        if kind:
            g = group_text(u)
            found[xxhash.xxh3_64_intdigest(g) - (1 << 63)] = (kind, kind == "strong" and (_PH in g or "◇" in g))
            only = only and kind == "strong"
        elif re.search(r"[^\W\d_]", u):  # a bare number says nothing
            whole = False
    return {h: (k, form or whole and only) for h, (k, form) in found.items()}, whole


def messages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, page, hash, kind, sure): each message of each document once. One pass; whole texts are read.

    ``page`` tells different texts apart: copies of a text with content have one, a text that is nothing but messages
    has one a document, as the same error page in several documents is what recurs.
    """

    def fn(_: None, ids: list, sources: list, texts: list) -> list:
        out: list[list] = [[] for _ in range(6)]
        for i, s, t in zip(ids, sources, texts):
            found, whole = text_messages(t)
            page = found and xxhash.xxh3_64_intdigest(f"{i} {s}" if whole else t) - (1 << 63)
            for h, (k, sure) in found.items():
                for col, v in zip(out, (i, s, page, h, k, sure)):
                    col.append(v)
        return out

    src = F.regexp_replace(F.lower(F.trim(F.col(source_col))), "[-\\s]+", "_")
    return map_rows(documents.select(id_col, src, text_col), "doc_id long, source string, page long, hash long, kind string, sure boolean", fn)


def groups(found: DataFrame) -> DataFrame:
    """One row a message hash: (hash, kind, n, n_sources), n counting different texts, so that copies of one document aren't recurrence.

    A null source is a source of its own. A message with a third of all rows is folded by each task, by text and
    source first.
    """
    each = found.select("hash", "kind", "page", F.coalesce("source", F.lit("")).alias("source")).distinct()
    return each.groupBy("hash", "kind").agg(F.count_distinct("page").alias("n"), F.count_distinct("source").alias("n_sources"))


def recurring(found: DataFrame, wide_docs: int = WIDE_DOCS, wide_sources: int = WIDE_SOURCES) -> DataFrame:
    """(hash, n): the messages that so many texts of so many sources have; n counts the rows of ``found``."""
    wide = groups(found).filter((F.col("n") >= wide_docs) & (F.col("n_sources") >= wide_sources)).select("hash").distinct()
    return found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).join(wide, "hash", "left_semi")


def with_residue(documents: DataFrame, wide_docs: int = WIDE_DOCS, wide_sources: int = WIDE_SOURCES) -> DataFrame:
    """(doc_id) of the documents to leave out, once each: those with a message that recurs widely or counts by itself.

    Null, empty and blank texts are no cases; copies of a document are cases each; an empty table gives none; extra
    columns aren't read.
    """
    found = cut(messages(documents))
    wide = recurring(found, wide_docs, wide_sources).withColumn("wide", F.lit(True))
    again = lookup_join(found.filter("not sure").select("doc_id", "hash"), wide, "hash").select("doc_id")
    return found.filter("sure").select("doc_id").unionByName(again).distinct()


def without_residue(documents: DataFrame, most: int = MOST_WIDE) -> DataFrame:
    """``documents`` but those of :func:`with_residue`; rows with a null id are judged by their text like others.

    Each text is judged where it is read, by the recurring messages, which are sent to every task: the documents don't
    shuffle. Should there be more than ``most`` of those, the ids are left out by a join.
    """
    found = cut(messages(documents))
    wide = [r.hash for r in recurring(found).select("hash").limit(most + 1).collect()]
    if len(wide) > most:
        return documents.join(with_residue(documents), "doc_id", "left_anti")
    shared = documents.sparkSession.sparkContext.broadcast(frozenset(wide))

    @F.pandas_udf("boolean")
    def has_residue(texts: pd.Series) -> pd.Series:
        return pd.Series([any(sure or h in shared.value for h, (_, sure) in text_messages(t)[0].items()) for t in texts], dtype=bool)

    return documents.filter(~has_residue("text"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_residue(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay."""
    return without_residue(spread(table(spark, sf_dir, "documents")))


def p9_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(messages(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))))

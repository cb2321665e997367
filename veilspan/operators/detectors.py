"""Span detectors: rules as expressions, one scan of the texts for all of them.

A finding is (rule, semantic_type, subtype, basis, start, end, value, scope, detail) with code-point offsets, end exclusive.
Overlapping findings are all kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import enums
from ..functions.network import RESERVED_NAMES, ipv4_scope, ipv6_scope, name_scope
from ..functions.spans import matches

#: Findings of one source in one text before the rest is reported as a limit.
CAP = 256


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` that pass ``keep`` (SQL over ``m``), with the reported span and facts as SQL over ``m``."""

    rule: str
    semantic_type: str
    subtype: str
    pattern: str
    groups: int = 0
    keep: str = "true"
    start: str = "m.s"
    end: str = "m.e"
    basis: str = "FORMAT"
    scope: str = "cast(null as string)"
    detail: str = "cast(null as string)"


# Names and patterns.
GUID = "[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
IPV4 = r"(?<![A-Za-z0-9.])(\d{1,3}(?:\.\d{1,3}){3})(?:\/(\d{1,2}))?(?::(\d{1,5}))?(?![A-Za-z0-9]|\.\d)"
IPV6 = r"(?<![\w:.])(\[)?((?:[0-9A-Fa-f]{1,4}:|:){2,7}(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f]{1,4}|:)?)(?:%[\w.-]{1,32})?(?:\/(\d{1,3}))?(?:\](?::(\d{1,5}))?)?(?![\w:]|\.[0-9A-Fa-f])"
MAC = r"(?<![\w:-])[0-9A-Fa-f]{2}([:-])[0-9A-Fa-f]{2}(?:\1[0-9A-Fa-f]{2}){4}(?![\w:-])"
DOMAIN = (
    r"(?<![\p{L}\p{N}_.-])((?:[\p{L}\p{N}](?:[\p{L}\p{M}\p{N}-]{0,61}[\p{L}\p{M}\p{N}])?\.){1,32}(?:xn--[a-z0-9-]{1,59}|\p{L}[\p{L}\p{M}\p{N}-]{0,61}[\p{L}\p{M}\p{N}]))"
    r"\.?(?::(\d{1,5}))?(?![\p{L}\p{N}_-]|\.[\p{L}\p{N}])"
)
# Schemes that are named; last labels of files, of known and of private names; names that code puts before a dot.
SCHEMES = (
    "http https ws wss ftp ftps sftp ssh git file ldap ldaps smb nfs mqtt mqtts amqp amqps redis rediss postgres postgresql mysql mongodb mongodb+srv jdbc opc.tcp modbus "
    "tcp udp s3 s3a gs abfs abfss wasb wasbs hdfs kafka grpc grpcs rtsp sip telnet"
)
FILE_SUFFIXES = (
    "cc pl pm ps mk json html htm js mjs cjs ts tsx jsx md txt yml yaml xml csv log png jpg jpeg gif svg pdf zip gz tgz tar py java go rs sh exe dll so "
    "css lock toml ini cfg conf bak tmp jar war class c h cpp hpp cs rb php sql db dat bin iso img env pem crt key pub map d test spec min bz2 xz "
    "docx xlsx pptx doc xls ppt dwg dxf step stp iges igs stl nc gcode"
)
KNOWN_SUFFIXES = (
    "com net org edu gov mil int info biz io ai app dev cloud tech online site xyz name pro mobi aero coop museum jobs travel asia arpa local internal "
    "lan corp intranet home invalid test example localhost onion services systems company global network digital group solutions industries energy engineering email link live store shop blog "
    "host team zone space page club works agency consulting studio tools media world bank health finance care gmbh berlin nyc london stockholm center support software security "
    "ventures partners capital technology institute academy education hosting server run codes build direct report data ltd inc co me tv us uk eu se no dk fi de nl"
)
PRIVATE_SUFFIXES = "svc consul lab prod production stage staging dmz k8s priv private intra cluster vpn office site plant mgmt infra ad domain dom loc int grp nas srv"
RECEIVERS = (
    "self this window document args argv config cfg ctx context req res request response resp app user job task foo bar obj object console data process module "
    "exports props state options opts params settings env os sys np pd df math json row item event e err error result value values model my location target utils lib"
)
GCP_PROJECT_KEY = r"""(?i)(?<![\w-])["']?(?:gcp[_-]?|google[_-]?)?project(?:[_-]?id)?["']?[ \t]*[:=][ \t]*["']?([a-z][a-z0-9-]{4,28}[a-z0-9])(?![\w-])"""
URL = r"""(?<![\w+.-])([A-Za-z][A-Za-z0-9+.-]{0,31})://([^\s"'<>`/?#]{1,512})([^\s"'<>`]{0,8192})"""
POSIX_PATH = r"(?<![\w/.~\\-])(~?/(?:[\w.@+-]{1,255}/){1,64}[\w.@+-]{0,255})"
WINDOWS_PATH = r"""(?<![\w\\])((?:\\\\\?\\)?[A-Za-z]:[\\/](?:[^\\/:*?"<>|\r\n\t]{1,255}[\\/]){0,64}[^\\/:*?"<>|\r\n\t ]{0,255})"""
UNC_PATH = r"""(?<![\w\\])(\\\\[\w.-]{1,255}\\[^\\/:*?"<>|\r\n\t ]{1,255}(?:\\[^\\/:*?"<>|\r\n\t ]{1,255}){0,64})"""
FILE_URL = r"""(?i)(?<![\w+.-])file://(?:localhost)?(/[^\s"'<>`]{1,4096})"""
ARN = r"""(?<![\w:-])arn:aws(?:-[a-z]{1,10}){0,2}:[a-z0-9-]{1,64}:[a-z0-9-]{0,32}:(\d{12})?:[^\s"'`<>,]{1,1024}"""
AZURE = rf"""(?i)/subscriptions/({GUID})(?:/resourceGroups/([\w().-]{{1,90}}))?(?:/providers/[^\s"'`<>,]{{1,1024}})?"""
GCP_PROJECT = r"(?<![\w~.-])projects/([a-z][a-z0-9-]{4,28}[a-z0-9])(?=/(?:zones|locations|global|regions|instances|topics|subscriptions|secrets|datasets|databases|buckets|serviceAccounts|logs|sinks|metrics|jobs)\b)"
BUCKET_URI = r"(?<![\w+.-])(?:s3a?|s3n|gs|abfss?|wasbs?)://([a-z0-9][a-z0-9._@-]{1,221}[a-z0-9])"
BUCKET_PATH = r"(?<![\w.-])(?:storage\.googleapis\.com|s3(?:[.-][a-z0-9-]{1,32})?\.amazonaws\.com)/([a-z0-9][a-z0-9._-]{1,221}[a-z0-9])"
BUCKET_HOST = r"(?<![\w.-])([a-z0-9][a-z0-9.-]{1,61}[a-z0-9])\.(?:s3(?:[.-][a-z0-9-]{1,32})?\.amazonaws\.com|storage\.googleapis\.com|blob\.core\.windows\.net|dfs\.core\.windows\.net)(?![\w-])"
SERVICE_ACCOUNT = r"(?<![\w.+-])[a-z][a-z0-9-]{4,62}@[a-z][a-z0-9-]{4,28}[a-z0-9]\.iam\.gserviceaccount\.com(?![\w-])"
EMAIL = (
    r"(?<![\p{L}\p{M}\p{N}_%+-])(?<![\p{L}\p{M}\p{N}_%+-]\.)[\p{L}\p{M}\p{N}_%+-](?:[\p{L}\p{M}\p{N}_%+'-]|\.(?=[\p{L}\p{M}\p{N}_%+'-])){0,63}@"
    r"(?:[\p{L}\p{N}](?:[\p{L}\p{M}\p{N}-]{0,61}[\p{L}\p{M}\p{N}])?\.){1,16}(?:xn--[a-z0-9-]{1,59}|\p{L}[\p{L}\p{M}]{1,47})"
    r"(?![\p{L}\p{M}\p{N}]|\.[\p{L}\p{N}])"
)
PHONE = r"(?<![\p{L}\p{N}_./@-])(?:\+|00)?\(?\d{1,4}\)?(?:[ \-.]?\(?\d{1,4}\)?){1,7}(?![\p{L}\p{N}_@]|[.:\-/]\d)"
PHONE_WORDS = r"(?:tel|telephone|phone|mobile|mob|mobil|cell|fax|telefon|tfn|tlf|ring)(?:\s*(?:number|no\.?|nr\.?|#))?"
PHONE_KEYWORD = rf"(?i)(?:(?:\b{PHONE_WORDS}|☎)(?:[\s.:#=-]{{0,4}}|[\x22\x27`]\s*[:=#]\s*[\x22\x27`]?|\s*[:=#]\s*[\x22\x27`])|<(?:[\w.-]+:)?\b{PHONE_WORDS}\s*>\s*)$"
CLOUD_KEY = rf"""(?<![\w-])["']?([A-Za-z_][\w.-]{{0,63}})["']?[ \t]*[:=][ \t]*["']?({GUID}|\d{{12}})(?![\w-])"""
NAME_KEY = r"""(?i)(?<![\w-])["']?((?:[A-Za-z]+[_.-]?)?(?:host(?:[_.-]?name)?|server(?:[_.-]?name)?|data source|endpoint|service|address|node|instance|cluster|env|environment|stage|tier))["']?[ \t]*[:=][ \t]*["']?(?:(?:tcp|np|lpc):)?([A-Za-z0-9][\w.-]{0,254})(?![\w.-]*(?:://|@))"""
HIGH_RISK = {
    "pattern.private-key-block": r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----|---- BEGIN SSH2 [A-Z ]{0,20}PRIVATE KEY ----|PuTTY-User-Key-File-\d",
    "pattern.cloud-access-key": r"(?<![0-9A-Z])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Z])",
    "pattern.source-control-token": r"gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{20,}",
    "pattern.chat-token": r"xox[abposr]-[A-Za-z0-9-]{10,}",
    "pattern.payment-key": r"(?:sk|rk)_live_[A-Za-z0-9]{16,}",
    "pattern.google-api-key": r"AIza[0-9A-Za-z_-]{35}",
    "pattern.llm-api-key": r"(?<![A-Za-z0-9])sk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}",
    "pattern.npm-token": r"npm_[A-Za-z0-9]{36}",
    "pattern.jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.",
    "pattern.authorization-credential": r"""(?i)authorization["']?\s*[:=]\s*["']?(?:bearer|basic|token)\s+[A-Za-z0-9._~+/=-]{8,}""",
}
ASSIGNMENT = r"""(?i)(password|passwd|pwd|secret|token|api[_-]?key|access[_-]?token|auth[_-]?token)["']?\s*[:=]\s*(?:(["'`])([^"'`\r\n]{4,})\2|([^\s"'`,;)]{4,}))"""

_OCTET = "cast(split(m.g1, r'\\.')[{0}] as int)"
_A, _B, _C, _D = (_OCTET.format(k) for k in range(4))
_NUMBER = f"(({_A} * 256L + {_B}) * 65536L + {_C} * 256 + {_D})"
_OCTETS = f"{_A} <= 255 and {_B} <= 255 and {_C} <= 255 and {_D} <= 255"
_PREFIX = "try_cast(nullif(m.g2, '') as int)"
_SERVICE = "element_at(map(" + ", ".join(f"{p}, '{n}'" for p, n in enums.WELL_KNOWN_PORTS.items()) + "), cast({0} as int))"
# Of an IPv6 match: the address without a colon that ends it, its embedded IPv4 address and that as two groups, all eight groups.
_ADDRESS6 = r"regexp_replace(m.g2, r'(?<!:):$', '')"
_TAIL4 = rf"regexp_extract({_ADDRESS6}, r'(\d{{1,3}}(?:\.\d{{1,3}}){{3}})$', 1)"
_PAIR = "lower(hex(cast(split({t}, r'\\.')[{a}] as int) * 256 + cast(split({t}, r'\\.')[{b}] as int)))".replace("\\\\", "\\")
_HEX6 = f"if({_TAIL4} = '', {_ADDRESS6}, concat(substring({_ADDRESS6}, 1, length({_ADDRESS6}) - length({_TAIL4})), {_PAIR.format(t=_TAIL4, a=0, b=1)}, ':', {_PAIR.format(t=_TAIL4, a=2, b=3)}))"
_FILLED = "filter(split({0}, ':'), g -> g <> '')"
_VALID6 = (
    f"({_HEX6} rlike r'^(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}$' or {_HEX6} rlike r'^(?:[0-9A-Fa-f]{{1,4}}(?::[0-9A-Fa-f]{{1,4}}){{0,6}})?::(?:[0-9A-Fa-f]{{1,4}}(?::[0-9A-Fa-f]{{1,4}}){{0,6}})?$'"
    f" and size({_FILLED.format(_HEX6)}) <= 7) and not exists(split({_TAIL4}, r'\\.'), o -> o <> '' and cast(o as int) > 255)"
    f" and not (contains(m.g2, '::') and not (m.g2 rlike r'\\d') and size({_FILLED.format('m.g2')}) < 3)"
).replace("\\\\", "\\")
_GROUPS6 = (
    f"transform(array({_HEX6}), h -> transform(if(contains(h, '::'), concat({_FILLED.format('substring_index(h, concat(chr(58), chr(58)), 1)')},"
    f" array_repeat('0', greatest(0, 8 - size({_FILLED.format('h')}))), {_FILLED.format('substring(h, instr(h, concat(chr(58), chr(58))) + 2)')}), split(h, ':')), g -> cast(conv(g, 16, 10) as int)))[0]"
)
_PREFIX6 = "if(try_cast(nullif(m.g3, '') as int) <= 128, try_cast(nullif(m.g3, '') as int), null)"
_END6 = f"m.e - case when m.g4 <> '' then length(m.g4) + 2 when m.g1 <> '' and m.v like '%]' then 1 else 0 end - if(m.g3 <> '' and {_PREFIX6} is null, length(m.g3) + 1, 0)"
_SCOPE6 = f"transform(array({_GROUPS6}), v -> {ipv6_scope('v', _PREFIX6)})[0]"
# Of a dotted name: conditions by name, over its labels l (in lower case) and o (as written).
_IN = lambda words, x: f"{x} in ({', '.join(repr(w) for w in words.split())})"
_CODE = f"forall(slice(o, 1, size(o) - 1), x -> {_IN(RECEIVERS, 'lower(x)')} or length(x) = 1 and not ({_IN(KNOWN_SUFFIXES, 'element_at(l, -1)')}) or x rlike '[a-z][A-Z]' or contains(x, '_'))"
_KNOWN = rf"({_IN(KNOWN_SUFFIXES, 'element_at(l, -1)')} or {_IN(PRIVATE_SUFFIXES, 'element_at(l, -1)')} or element_at(l, -1) like 'xn--%' or element_at(l, -1) rlike r'[^\x00-\x7f]')"
_NAMED = {
    "in_context": "(substring(text, m.s - 1, 2) = '//' and m.s > 1 or m.s > 0 and substring(text, m.s, 1) = '@' or m.g2 <> '')",
    "version": r"(o[0] rlike r'(?i)^v?\d+$' and o[1] rlike r'^\d+')",
    "variable": f"(element_at(o, -1) rlike '^[A-Z]{{3,}}$' and ({_CODE} or not {_KNOWN} and exists(slice(o, 1, size(o) - 1), x -> x rlike '[a-z]')))",
    "marked": r"(m.g1 rlike r'[\d-]')",
    "code": f"({_CODE})",
    "named": f"({_KNOWN} or element_at(l, -1) rlike '^[a-z]{{2}}$')",
    "file": f"({_IN(FILE_SUFFIXES, 'element_at(l, -1)')})",
}
_IS_HOST = "{in_context} or not {version} and not {variable} and (size(l) >= 3 and {marked} or not ({code} and not {marked}) and {named})".format(**_NAMED)
_DNS = rf"(m.g1 rlike r'{RESERVED_NAMES}' or transform(array(struct(split(m.g1, r'\.') as o, split(lower(m.g1), r'\.') as l)), z -> transform(array(z.o), o -> transform(array(z.l), l -> not {_NAMED['file']} and ({_IS_HOST}))[0])[0])[0])"
# Of a phone match: without a parenthesis that has no partner, a pair around all of it, and separators that end it.
_OPEN, _CLOSE = "length(regexp_replace({0}, r'[^(]', ''))", "length(regexp_replace({0}, r'[^)]', ''))"
_PHONE1 = f"if({_CLOSE.format('m.v')} > {_OPEN.format('m.v')}, regexp_replace(m.v, r'\\)$', ''), m.v)".replace("\\\\", "\\")
_PHONE2 = f"if({_OPEN.format(_PHONE1)} > {_CLOSE.format(_PHONE1)}, regexp_replace({_PHONE1}, r'^\\(', ''), {_PHONE1})".replace("\\\\", "\\")
_PHONE3 = rf"regexp_replace(regexp_replace({_PHONE2}, r'^\(([^()]*)\)$', '$1'), r'[ \-.]+$', '')"
_PHONE_AT = f"m.s + if({_PHONE1} <> {_PHONE2}, 1, 0) + if({_PHONE2} rlike r'^\\([^()]*\\)$', 1, 0)".replace("\\\\", "\\")
_DIGITS = rf"regexp_replace({_PHONE3}, r'\D', '')"
_BEFORE = f"substring(text, greatest(1, {_PHONE_AT} - 31), least(32, {_PHONE_AT}))"
_KEYWORD = f"{_BEFORE} rlike r'{PHONE_KEYWORD}'"
_INTERNATIONAL = f"({_PHONE3} like '+%' or {_PHONE3} like '00%')"
_MARKS = rf"regexp_replace({_PHONE3}, r'[\d+]', '')"
_PLAUSIBLE = {
    "as many digits as numbers have": f"length({_DIGITS}) between 7 and 15",
    "no bare key or reference before": f"({_KEYWORD} or not ({_BEFORE} rlike '[:=#]$'))",
    "no version": rf"({_INTERNATIONAL} or {_KEYWORD} or not ({_MARKS} rlike r'^\.+$'))",
    "no date": rf"not ({_PHONE3} rlike r'^\d{{4}}-\d{{2}}-\d{{2}}$')",
    "no bare run of digits": f"(regexp_replace({_MARKS}, '[()]', '') <> '' or {_INTERNATIONAL} or {_KEYWORD})",
    "parentheses in pairs": f"{_OPEN.format(_PHONE3)} = {_CLOSE.format(_PHONE3)}",
}
_TRIM = r"regexp_replace(m.g1, r'[.,;:)\]]+$', '')"
_QUOTE = "substring(text, m.s, 1)"
_CLOSED = f"locate({_QUOTE}, text, m.s + length({_TRIM}) + 1)"
_LINE_END = f"locate(chr(10), text, m.s + length({_TRIM}) + 1)"
#: A path in quotes goes to the closing quote of its line.
_PATH_END = f"if(m.s > 0 and {_QUOTE} in (chr(34), chr(39)) and {_CLOSED} > m.s + length({_TRIM}) + 1 and ({_LINE_END} = 0 or {_CLOSED} < {_LINE_END}), {_CLOSED} - 1, m.s + length({_TRIM}))"
_HOSTPORT = "regexp_replace(m.g2, r'^.*@', '')"
_HOST = rf"regexp_replace(regexp_extract({_HOSTPORT}, r'^(\[[^\]]{{1,64}}\]|[^:]{{1,255}})(?::(\d{{1,5}}))?$', 1), r'\.$', '')"
_PORT = rf"regexp_extract({_HOSTPORT}, r'^(\[[^\]]{{1,64}}\]|[^:]{{1,255}})(?::(\d{{1,5}}))?$', 2)"
_HOST_AT = f"m.s + length(m.g1) + 3 + length(m.g2) - length({_HOSTPORT})"
#: What ends a URL and is not part of it: punctuation, and as many closing parentheses as have no partner.
_EXCESS = "greatest(0, length(regexp_replace(m.g3, r'[^)]', '')) - length(regexp_replace(m.g3, r'[^(]', '')))"
_URL_TAIL = "length(regexp_extract(m.g3, concat('(?:[.,;:!?', chr(39), r'\\]}]*\\)){0,', " + _EXCESS + ", '}[.,;:!?', chr(39), r'\\]}]*$'), 0))"
_KEY = "regexp_replace(lower(m.g1), '[^a-z]', '')"
_ENVIRONMENT = r"lower(m.g1) rlike r'(?:^|[_.-])(?:env|environment|stage|tier)$'"

RULES: tuple[Rule, ...] = (
    Rule("format.ipv4", "NETWORK_IDENTIFIER", "IP", IPV4, 3, f"{_OCTETS} and coalesce({_PREFIX}, 33) > 32", "m.s", "m.s + length(m.g1)", scope=ipv4_scope(_NUMBER)),
    Rule("format.ipv4", "NETWORK_IDENTIFIER", "SUBNET", IPV4, 3, f"{_OCTETS} and {_PREFIX} <= 32", "m.s", "m.s + length(m.g1) + 1 + length(m.g2)", scope=ipv4_scope(_NUMBER, _PREFIX)),
    Rule("format.ip-port", "NETWORK_IDENTIFIER", "PORT", IPV4, 3, f"{_OCTETS} and m.g3 <> '' and cast(m.g3 as int) <= 65535", "m.e - length(m.g3)", detail=_SERVICE.format("m.g3")),
    Rule("format.ipv6", "NETWORK_IDENTIFIER", "IP", IPV6, 4, f"{_VALID6} and {_PREFIX6} is null", "m.s + length(m.g1)", _END6, scope=_SCOPE6),
    Rule("format.ipv6", "NETWORK_IDENTIFIER", "SUBNET", IPV6, 4, f"{_VALID6} and {_PREFIX6} is not null", "m.s + length(m.g1)", _END6, scope=_SCOPE6),
    Rule("format.ip-port", "NETWORK_IDENTIFIER", "PORT", IPV6, 4, f"{_VALID6} and m.g4 <> '' and cast(m.g4 as int) <= 65535", "m.e - length(m.g4)", detail=_SERVICE.format("m.g4")),
    Rule("format.dns-name", "HOST_OR_SERVICE", "", DOMAIN, 2, _DNS, end="m.s + length(m.g1)", scope=name_scope("m.g1")),
    Rule("format.host-port", "NETWORK_IDENTIFIER", "PORT", DOMAIN, 2, f"m.g2 <> '' and cast(m.g2 as int) <= 65535 and {_DNS}", "m.e - length(m.g2)", detail=_SERVICE.format("m.g2")),
    Rule("format.mac", "NETWORK_IDENTIFIER", "MAC", MAC, 1),
    Rule("format.url", "NETWORK_IDENTIFIER", "URL", URL, 3, end=f"m.e - {_URL_TAIL}", detail=f"if({_IN(SCHEMES, 'lower(m.g1)')}, lower(m.g1), 'OTHER')"),
    Rule("format.url-host", "HOST_OR_SERVICE", "", URL, 3, rf"{_HOST} <> '' and not ({_HOST} rlike r'^\[|^[\d.]+$')", _HOST_AT, f"{_HOST_AT} + length({_HOST})", scope=name_scope(_HOST)),
    Rule("format.url-port", "NETWORK_IDENTIFIER", "PORT", URL, 3, f"{_PORT} <> '' and cast({_PORT} as int) <= 65535", f"m.s + length(m.g1) + 3 + length(m.g2) - length({_PORT})", "m.s + length(m.g1) + 3 + length(m.g2)", detail=_SERVICE.format(_PORT)),
    Rule("format.posix-path", "FILE_OR_RESOURCE_PATH", "", POSIX_PATH, 1, f"length({_TRIM}) >= 3", end=_PATH_END, detail="'POSIX'"),
    Rule("format.windows-path", "FILE_OR_RESOURCE_PATH", "", WINDOWS_PATH, 1, f"length({_TRIM}) >= 3", end=_PATH_END, detail="'WINDOWS'"),
    Rule("format.unc-path", "FILE_OR_RESOURCE_PATH", "", UNC_PATH, 1, f"length({_TRIM}) >= 3", end=_PATH_END, detail="'UNC'"),
    Rule("format.file-url", "FILE_OR_RESOURCE_PATH", "", FILE_URL, 1, start="m.e - length(m.g1)", detail="if(m.g1 rlike r'^/[A-Za-z]:', 'WINDOWS', 'POSIX')"),
    Rule("format.aws-arn", "CLOUD_RESOURCE", "ARN", ARN, 1, detail="'AWS'"),
    Rule("format.aws-arn-account", "CLOUD_RESOURCE", "ACCOUNT_ID", ARN, 1, "m.g1 <> ''", "m.s + instr(m.v, concat(':', m.g1, ':'))", "m.s + instr(m.v, concat(':', m.g1, ':')) + 12", detail="'AWS'"),
    Rule("format.azure-subscription", "CLOUD_RESOURCE", "SUBSCRIPTION_ID", AZURE, 2, start="m.s + 15", end="m.s + 51", detail="'AZURE'"),
    Rule("format.azure-resource-group", "CLOUD_RESOURCE", "RESOURCE_GROUP", AZURE, 2, "m.g2 <> ''", "m.s + 67", "m.s + 67 + length(m.g2)", detail="'AZURE'"),
    Rule("format.gcp-project", "CLOUD_RESOURCE", "PROJECT_ID", GCP_PROJECT, 1, start="m.s + 9", detail="'GCP'"),
    Rule("context.gcp-project-key", "CLOUD_RESOURCE", "PROJECT_ID", GCP_PROJECT_KEY, 1, start="m.e - length(m.g1)", basis="CONTEXT", detail="'GCP'"),
    Rule("format.bucket-uri", "CLOUD_RESOURCE", "BUCKET", BUCKET_URI, 1, start="m.e - length(m.g1)", detail="case when m.v like 'gs%' then 'GCP' when m.v like 's3%' then 'AWS' else 'AZURE' end"),
    Rule("format.bucket-host", "CLOUD_RESOURCE", "BUCKET", BUCKET_HOST, 1, end="m.s + length(m.g1)", detail="case when m.v like '%amazonaws%' then 'AWS' when m.v like '%googleapis%' then 'GCP' else 'AZURE' end"),
    Rule("format.bucket-path", "CLOUD_RESOURCE", "BUCKET", BUCKET_PATH, 1, start="m.e - length(m.g1)", detail="if(m.v like '%googleapis%', 'GCP', 'AWS')"),
    Rule("format.gcp-service-account", "CLOUD_RESOURCE", "SERVICE_ACCOUNT", SERVICE_ACCOUNT, detail="'GCP'"),
    Rule("context.cloud-key", "CLOUD_RESOURCE", "", CLOUD_KEY, 2, f"{_KEY} rlike 'tenant|directory|subscription|account|client|application|appid|principal|object|aws|cloud|azure|gcp' and (length(m.g2) > 12 or {_KEY} like '%account%')",
         "m.e - length(m.g2)", basis="CONTEXT", detail=f"case when {_KEY} rlike 'tenant|directory' then 'TENANT_ID' when {_KEY} like '%subscription%' then 'SUBSCRIPTION_ID' else 'ACCOUNT_ID' end"),
    Rule("context.name-key", "HOST_OR_SERVICE", "", NAME_KEY, 2,
         rf"not {_ENVIRONMENT} and not (m.g2 rlike r'(?i)^(?:true|false|null|none|\d+)$|^v?\d+(?:\.\d+)+') and not (lower(m.g1) rlike '(?:address|service|node)$' and not (m.g2 rlike r'[.\d-]'))",
         "m.e - length(m.g2)", basis="CONTEXT", scope=name_scope("m.g2")),
    Rule("context.name-key", "APPLICATION_OR_ENVIRONMENT", "", NAME_KEY, 2, rf"{_ENVIRONMENT} and not (m.g2 rlike r'(?i)^(?:true|false|null|none|\d+)$|^v?\d+(?:\.\d+)+')", "m.e - length(m.g2)", basis="CONTEXT"),
    Rule("format.email", "PERSON", "EMAIL", EMAIL),
    Rule("format.phone", "PERSON", "PHONE", PHONE, 0, " and ".join(_PLAUSIBLE.values()), _PHONE_AT, f"{_PHONE_AT} + length({_PHONE3})", detail=f"if({_KEYWORD}, 'KEYWORD_CONTEXT', 'PATTERN')"),
    *(Rule(name, "CREDENTIAL_OR_SECRET", "", pattern) for name, pattern in HIGH_RISK.items()),
    Rule("context.assignment", "CREDENTIAL_OR_SECRET", "", ASSIGNMENT, 4,
         r"if(m.g4 = '', not (m.g3 rlike r'^(?:\$\{[^}]*\}|\{\{[^}]*\}\}|<[\w -]{1,40}>|\*{3,})$'),"
         r" length(regexp_replace(m.g4, r'[}\]]+$', '')) >= 4 and not (m.g4 rlike r'(?i)^(?:[$<*{\[]|(?:string|number|boolean|object|any|unknown|undefined|null|none|true|false)$|[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*|\[[^\]]*\])+$)') and lower(regexp_replace(m.g4, '[_-]', '')) <> lower(regexp_replace(m.g1, '[_-]', '')))",
         basis="CONTEXT", detail="lower(m.g1)"),
)


#: Cheap conditions that a text with a match of a pattern meets.
GATES = {
    IPV4: r"text rlike r'\d\.\d{1,3}\.\d'", IPV6: "text rlike ':[0-9A-Fa-f]{0,4}:'", DOMAIN: r"text rlike r'[\p{L}\p{N}]\.\p{L}'", MAC: "text rlike '[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]'", URL: "contains(text, '://')", FILE_URL: "contains(text, '://')", BUCKET_URI: "contains(text, '://')",
    POSIX_PATH: "contains(text, '/')", WINDOWS_PATH: r"text rlike r'[A-Za-z]:[\\/]'", UNC_PATH: r"contains(text, r'\\')", ARN: "contains(text, 'arn:aws')", AZURE: "contains(lower(text), '/subscriptions/')", GCP_PROJECT: "contains(text, 'projects/')", GCP_PROJECT_KEY: "contains(lower(text), 'project')",
    BUCKET_PATH: "text rlike 'googleapis|amazonaws'", BUCKET_HOST: "text rlike 'googleapis|amazonaws|core[.]windows'", SERVICE_ACCOUNT: "contains(text, 'gserviceaccount')", EMAIL: "contains(text, '@')", PHONE: r"text rlike r'\d{1,4}[ ().-]{0,3}\d'", CLOUD_KEY: r"text rlike r'[:=][ \t]*[\x22\x27]?[0-9A-Fa-f]{8}'", NAME_KEY: "text rlike '[:=]'",
    ASSIGNMENT: "text rlike '[:=]'",
}


def findings(texts: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id") -> DataFrame:
    """One row a finding of ``texts(key, text)``; the texts are read once for all rules, and equal patterns are matched once."""
    patterns = sorted({(r.pattern, r.groups) for r in rules})
    name = {p: f"_p{k}" for k, (p, _) in enumerate(patterns)}
    out = texts.select(key, F.col("text").cast("string").alias("text")).where("text is not null")
    out = out.select(key, "text", *(F.expr(matches(p, g, gate=GATES.get(p, ""))).alias(name[p]) for p, g in patterns))
    each = [
        f"transform(filter({name[r.pattern]}, m -> {r.keep}), m -> struct('{r.rule}' as rule, '{r.semantic_type}' as semantic_type, nullif('{r.subtype}', '') as subtype, '{r.basis}' as basis,"
        f" cast({r.start} as int) as start, cast({r.end} as int) as end, cast({r.scope} as string) as scope, cast({r.detail} as string) as detail))"
        for r in rules
    ]
    rows = out.select(key, "text", F.explode(F.expr(f"concat({', '.join(each)})")).alias("f"))
    return rows.select(key, "f.*", F.expr("substring(text, f.start + 1, f.end - f.start)").alias("value")).where("end > start")


def deduplicated(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One finding for each (span, type, subtype) of a text: the rule that comes first."""
    place = F.array_position(F.array(*map(F.lit, dict.fromkeys(r.rule for r in RULES))), F.col("rule"))
    order = Window.partitionBy(key, "start", "end", "semantic_type", "subtype").orderBy(place)
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def capped(found: DataFrame, key: str = "doc_id", cap: int = CAP) -> DataFrame:
    """Findings with ``place`` in their text and ``over``: beyond the cap.  Nothing is dropped; what is over is reported as such."""
    order = Window.partitionBy(key).orderBy("start", "end", "rule", "semantic_type")
    return found.withColumn("place", F.row_number().over(order)).withColumn("over", F.col("place") > cap)


def status(texts: DataFrame, found: DataFrame, key: str = "doc_id", cap: int = CAP) -> DataFrame:
    """(key, status, reasons, n): every text has a status; COMPLETE never means clean."""
    n = found.groupBy(key).agg(F.count("*").alias("n"))
    out = texts.select(key, "text").join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    why = enums.reasons((F.col("text").isNull(), "INVALID_INPUT"), (F.col("n") > cap, "CANDIDATE_LIMIT"), (F.length("text") > 1048576, "INPUT_LIMIT"))
    out = out.withColumn("reasons", why)
    state = F.when(F.array_contains("reasons", "INVALID_INPUT"), "FAILURE").when(F.size("reasons") > 0, "PARTIAL").otherwise("COMPLETE")
    return out.select(key, state.alias("status"), "reasons", "n")

"""Scalar expressions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a bank's name, headings, keywords of each intent in their order.
BANK_WORDS = ("银行", "bank", "储蓄", "农信", "农商", "信用合作")
HEADING = "^(第[一二三四五六七八九十百千\\d]+[条章]\\s*|[一二三四五六七八九十]+、|（[一二三四五六七八九十]+）|\\d+\\.\\s+|(总则|分则|附则|附录|附件)\\s*)"
INTENTS = {
    "INTENT_AGENT_ISSUANCE": ("出票预检", "能否出票", "可以出票吗", "出票合规", "出票资质", "出票申请审核", "出票前审核"),
    "INTENT_AGENT_DISCOUNT": ("能否贴现", "可以贴现吗", "贴现审核", "贴现申请审核", "贴现可行性", "能做贴现", "申请贴现审核"),
    "INTENT_AGENT_ENDORSEMENT": ("背书链分析", "背书连续性审核", "背书合规审核", "背书链合规", "审核背书", "背书链报告", "背书是否合规", "背书申请", "能否背书", "可以背书", "背书校验", "校验背书", "背书转让", "申请背书"),
    "INTENT_AGENT_FRAUD": ("欺诈检测", "欺诈筛查", "票据真伪", "是否造假", "印章真伪", "是否重复票据", "篡改检测", "黑名单查询"),
    "INTENT_AGENT_COMPLIANCE": ("合规审核", "合规检查", "要素合规", "票据合规报告", "合规性报告", "全要素合规", "出票合规报告"),
    "INTENT_AGENT_FULL_AUDIT": ("全流程审核", "完整审核", "全面审核", "综合审核报告", "全套审核", "完整合规报告", "审核报告"),
    "INTENT_PRICING": ("利率", "定价", "贴现率", "报价", "折扣率", "转贴现", "再贴现"),
    "INTENT_ENDORSER_CHECK": ("背书", "背书人", "背书链", "连续背书", "签章", "被背书人"),
    "INTENT_EXPIRY": ("到期", "追索权", "时效", "逾期", "拒付", "付款期", "追索"),
    "INTENT_AML": ("大额", "反洗钱", "报告义务", "AML", "尽职调查", "可疑交易"),
    "INTENT_ELEMENT_CHECK": ("要素", "矛盾", "核验", "审查", "不规范", "无效票", "缺失"),
    "INTENT_HISTORY": ("流转", "历史", "版本", "背书记录", "溯源", "转让记录"),
    "INTENT_BATCH_RISK": ("批量", "集中度", "敞口", "风险汇总", "同一承兑", "同一出票"),
    "INTENT_PLEDGE": ("质押", "质押率", "抵押", "融资", "担保", "质押融资"),
}


def present(c: str | Column) -> Column:
    """Whether a text is neither null nor empty."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (c != "")


def present_number(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != 0)


def as_date(c: str) -> Column:
    """A date from a text's first ten characters; null for anything else."""
    return F.try_to_date(F.substring(F.col(c), 1, 10), "yyyy-M-d")


def count_tokens(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[\\x{4e00}-\\x{9fff}]")) + F.regexp_count(c, F.lit("[a-zA-Z0-9]+"))


def detect_section(c: Column) -> Column:
    text = F.trim(c)
    return F.when(F.regexp_like(text, F.lit(HEADING)), F.trim(F.substring(text, 1, 30)))


def inject_prefix(text: Column, section: Column) -> Column:
    plain = section.isNull() | (section == "") | F.startswith(text, section)
    return F.when(plain, text).otherwise(F.concat(F.lit("[章节："), section, F.lit("] "), text))


def amount_tier(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(0.0)) == 0, "").when(c >= 1e7, "特大额").when(c >= 5e6, "大额").when(c >= 1e6, "中额").otherwise("小额")


def period_label(days: Column) -> Column:
    return F.when(days <= 30, "≤30").when(days <= 90, "≤90").when(days <= 180, "≤180").when(days <= 365, "≤365").otherwise(">365")


def parse_amount(c: Column) -> Column:
    return F.regexp_replace(c, "[,，]", "").try_cast("double")


def bank_name(c: str) -> Column:
    low = F.lower(F.col(c))
    return F.greatest(*(F.contains(low, F.lit(w)) for w in BANK_WORDS))


def keyword_intent(c: Column) -> Column:
    """The first intent one of whose words the text holds; null if none."""
    out = None
    for intent, words in INTENTS.items():
        hit = F.greatest(*(F.contains(c, F.lit(w)) for w in words)) if len(words) > 1 else F.contains(c, F.lit(words[0]))
        out = F.when(hit, intent) if out is None else out.when(hit, intent)
    return out


def truncate_bytes(c: Column, n: int) -> Column:
    """At most ``n`` UTF-8 bytes without NUL, never ending inside a character."""
    clean = F.replace(c, F.lit("\0"), F.lit(""))
    raw = F.encode(clean, "utf-8")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, n - k).cast("string")) for k in range(4)]
    return F.when(F.octet_length(clean) <= n, clean).otherwise(F.coalesce(*cuts))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: str) -> Column:
    length = F.sqrt(dot(v, v)) + F.lit(1e-8)
    # A list of the one length, so that it is not worked out again for every number.
    return F.transform(F.array(length), lambda n: F.transform(v, lambda x: x.cast("double") / n))[0]


# Words that greet, the fields each intent looks at, tasks and titles of agent intents.
GREETINGS = (
    "你好|您好|hi|hello|hey|嗨|哈喽|早上好|下午好|晚上好|早安|晚安|在吗|在不在|有人吗|请问|能帮我吗|你是谁|你叫什么|你能做什么|你有什么功能"
    "|帮个忙|问个问题|请教一下|咨询一下|想问问|介绍一下你自己|你好啊|你好呀|您好啊|您好呀"
)
INTENT_FIELDS = {
    "INTENT_PRICING": ("acceptor", "ticket_type", "due_date", "amount_numeric"),
    "INTENT_ENDORSER_CHECK": ("endorsers", "drawer", "payee"),
    "INTENT_EXPIRY": ("due_date", "ticket_type", "issue_date"),
    "INTENT_AML": ("amount_numeric", "drawer", "drawer_bank", "ticket_type"),
    "INTENT_ELEMENT_CHECK": ("ticket_type", "acceptor", "issue_date", "due_date", "amount_numeric", "amount_text"),
    "INTENT_HISTORY": ("ticket_number",),
    "INTENT_BATCH_RISK": ("acceptor", "drawer", "amount_numeric"),
    "INTENT_PLEDGE": ("ticket_type", "acceptor", "due_date", "amount_numeric", "endorsers"),
}
AGENT_TASKS = {
    "INTENT_AGENT_ISSUANCE": "issuance_check", "INTENT_AGENT_DISCOUNT": "discount_apply", "INTENT_AGENT_ENDORSEMENT": "endorsement",
    "INTENT_AGENT_FRAUD": "full_audit", "INTENT_AGENT_COMPLIANCE": "issuance_check", "INTENT_AGENT_FULL_AUDIT": "full_audit",
}
# Labels of a purpose, an acceptance clause and remarks.
PURPOSE_LABELS = ("贸易背景：", "贸易背景:", "用途：", "用途:", "资金用途：")
CLAUSE_LABELS = ("承兑条款：", "承兑条款:", "承兑条件：", "特别承兑条款：")
REMARK_LABELS = ("其他记载事项：", "特殊事项：", "备注：", "备注:")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_greeting(c: Column) -> Column:
    text = stripped(c)
    return (F.length(text) <= 30) & F.regexp_like(text, F.lit(rf"(?i)^({GREETINGS})([？?！!。,，、\s]+({GREETINGS}))*[？?！!。,，、\s]*$"))


def is_specialized(intent: Column, confidence: Column) -> Column:
    return F.coalesce(intent.isNotNull() & (confidence >= 0.75), F.lit(False))


def is_off_topic(intent: Column, text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text has neither an intent nor one of a domain's words."""
    hits = [F.contains(text, F.lit(w)) for w in words]
    return intent.isNull() & ~F.coalesce(F.exists(F.array(*hits), lambda x: x), F.lit(False))


def agent_task(intent: Column) -> Column:
    out = F.lit("full_audit")
    for name, task in AGENT_TASKS.items():
        out = F.when(intent == name, task).otherwise(out)
    return out


def plain(field: str) -> Column:
    """A field as text; null if it is null, empty or 0. Amounts have two decimals."""
    if field == "amount_numeric":
        return F.when(present_number(field), F.col(field).cast("decimal(20,2)").cast("string"))
    if field == "endorsers":
        return F.when(F.size(field) > 0, F.array_join(field, ","))
    if field == "maturity_days":
        return F.when(F.col(field) != 0, F.col(field).cast("string"))
    return F.when(present(field), F.col(field).cast("string"))


def search_query(query: Column, intent: Column) -> Column:
    """A query with the fields of the bill that its intent looks at, as field:value."""
    out = query
    for name, fields in INTENT_FIELDS.items():
        named = [F.when(plain(f) != "null", F.concat(F.lit(f"{f}:"), plain(f))) for f in fields]
        out = F.when(intent == name, F.concat_ws(" ", query, *named)).otherwise(out)
    return out


def fingerprint(*fields: str) -> Column:
    """24 hex digits of a row's fields; a null and an empty field are alike."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.concat(F.lit(f"{f}="), F.coalesce(plain(f), F.lit(""))) for f in sorted(fields))), 256), 1, 24)


def query_fingerprint(query: Column, bill: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", stripped(query), bill), 256), 1, 24)


def labelled(c: Column, labels: tuple[str, ...], most: int) -> Column:
    """What follows the first of the labels, in their order, up to the line's end; in the last line
    at most ``most`` characters. Null without a label."""
    out = F.lit(None).cast("string")
    for label in reversed(labels):
        at = F.instr(c, label)
        rest = F.substring(c, at + len(label), F.length(c))
        end = F.instr(rest, "\n")
        out = F.when(at > 0, stripped(F.when(end > 0, F.substring(rest, F.lit(1), end - 1)).otherwise(F.substring(rest, 1, most)))).otherwise(out)
    return out


def stated_amount(c: Column) -> Column:
    """The first amount in yuan of a contract; times 10,000 if 万元 stands within ten characters of
    where its digits first occur."""
    digits = F.regexp_extract(c, r"([\d,]+(?:\.\d+)?)\s*(?:万元|元整|元)", 1)
    near = F.substring(c, F.position(digits, c), F.lit(10))
    value = F.replace(digits, F.lit(","), F.lit("")).try_cast("double")
    return F.when(digits != "", F.when(F.contains(near, F.lit("万元")), value * 10_000).otherwise(value))


def json_block(c: Column) -> Column:
    """From the first { to the last }; null without one."""
    found = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def masked(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 4), F.lit("****"))


def bill_text() -> Column:
    """A bill as a sentence for the index. Its words are fixed values."""
    say = lambda f, default="未知": F.coalesce(plain(f), F.lit(default))
    amount = F.format_number(F.coalesce("amount_numeric", F.lit(0.0)), 2)
    parts = (
        "票据号码 ", say("ticket_number"), " 的", say("ticket_type", "票据"), "，出票人：", say("drawer"), "（账号：", say("drawer_account"), "，开户行：", say("drawer_bank"),
        "），承兑人：", say("acceptor"), "，付款行：", say("drawee_bank"), "，出票日期：", say("issue_date"), "，到期日：", say("due_date"), "，票面金额：", say("currency", "人民币"),
        say("amount_text"), "（¥", amount, "），收款人：", say("payee"), "，背书人：[", F.when(F.size("endorsers") > 0, F.array_join("endorsers", "、")).otherwise("无"), "]",
    )
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


# Fixed value: the standard namespace of object identifiers.
OID_NAMESPACE = "6ba7b812-9dad-11d1-80b4-00c04fd430c8"


def uuid5(namespace: Column, name: Column) -> Column:
    """The version 5 UUID of a name (its UTF-8 bytes) in a namespace, itself a UUID as text."""
    h = F.sha1(F.concat(F.unhex(F.replace(namespace, F.lit("-"), F.lit(""))), F.encode(name.cast("string"), "UTF-8")))
    part = lambda start, n: F.substring(h, start, n)
    # The version stands in the seventh byte; the two highest bits of the ninth are 1 and 0.
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))

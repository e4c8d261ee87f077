"""What is searched for a question about a bill, by the question's scene."""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from draftlake.functions import exprs as E

# For each scene the queries for each item of a list, those that are always asked, those
# asked where there are no others, and the hint about the bill. Names in braces are fields.
SCENES = {
    "INTENT_PRICING": (
        {"named_acceptor": "{item} 承兑额度 授信评级 风险等级 票据承兑"},
        ["{ticket_type} {period} 贴现利率 定价基准 转贴现 市场行情 {tier}"],
        [],
        "用户查询票据贴现定价。当前票据：{ticket_type}，承兑人：{acceptor}，剩余期限约 {days} 天，票面金额约 {amount} 元。请结合检索到的利率文件和内部授信政策，给出精确的定价区间和依据。",
    ),
    "INTENT_ENDORSER_CHECK": (
        {"named_drawer": "{item} 出票人 失信被执行 票据拒付 黑名单 风险记录 制裁", "endorsers": "{item} 背书人 失信被执行 票据拒付 黑名单 风险记录 制裁"},
        [],
        ["票据背书链 风险核查 合规要求"],
        "用户请求背书链风险核查。共 {n_subjects} 个主体需要核查：{subjects}。请逐主体说明风险发现情况，无命中记录也须明确说明。",
    ),
    "INTENT_EXPIRY": (
        {},
        ["{ticket_type} 持票人追索权 诉讼时效 到期后多少天 票据法第17条", "票据拒付 追索权行使程序 被追索人 法律救济"],
        [],
        "用户查询票据追索权时效。当前票据：{ticket_type}，{overdue}。请结合票据法和司法解释，精确计算各追索对象的时效是否届满，给出明确结论。",
    ),
    "INTENT_AML": (
        {},
        ["大额交易报告 {tier} 票据业务 反洗钱 义务 时限 人民银行", "贴现业务 客户尽职调查 出票人 开户行核验 {ticket_type}"],
        [],
        "用户查询大额票据合规义务。票面金额 {whole_amount} 元（{tier}），出票人：{drawer}，开户行：{drawer_bank}。请列出需履行的报告义务、时限要求和核验清单，每条注明监管依据。",
    ),
    "INTENT_ELEMENT_CHECK": (
        {"flag_questions": "{item}"},
        [],
        ["票据要素合规性 必要记载事项 票据法第22条 要素效力"],
        "用户请求票据要素合规审查。已检测到 {n_flags} 处风险：{flag_texts}。请逐条引用监管条文，给出每处风险的法律定性和处置建议。",
    ),
    "INTENT_HISTORY": (
        {"new_endorsers": "{item} 风险 黑名单 票据纠纷 经营异常"},
        ["票据背书转让 背书连续性 规范要求 票据法第31条"],
        [],
        "用户查询票据流转历史。本次新增背书人：{new_list}。请核查新增背书人风险记录，并验证背书链连续性是否符合票据法要求。",
    ),
    "INTENT_BATCH_RISK": (
        {},
        ["{acceptor} 承兑额度上限 集中度风险 内部授信限额", "单一承兑行 票据承兑敞口 风险集中 银保监规定 {total_tier}"],
        [],
        "用户查询批量票据集中度风险。承兑人：{acceptor}，本批 {bill_count} 张，累计金额约 {whole_total} 元（{total_tier}）。请检索内部集中度限额政策，判断是否超限并给出处置建议。",
    ),
    "INTENT_PLEDGE": (
        {},
        ["{ticket_type} {acceptor} 质押率 折扣率 质押融资", "票据质押融资 {period} 利率 质押贷款条件 融资成本", "票据质押背书 格式规范 票据法第35条 质押字样"],
        [],
        "用户咨询票据质押融资方案。票据：{ticket_type}，承兑人：{acceptor}，剩余期限约 {days} 天，票面金额 {whole_amount} 元。请给出质押率区间、可融资金额、参考利率和背书规范要求，每项注明依据。",
    ),
}
# What is asked about each flag.
FLAG_QUESTIONS = {
    "DATE_LOGIC_ERROR": "票据到期日早于出票日 法律效力 如何认定 票据法第22条必要记载事项",
    "ACCEPTOR_NOT_BANK": "银行承兑汇票承兑人必须是银行 商业主体承兑是否有效 票据法第38条",
    "AMOUNT_MISMATCH": "票据大写金额与数字金额不符 如何认定效力 票据法记载错误",
    "TENOR_TOO_LONG": "商业汇票承兑期限最长6个月 人行规定 超期如何处理",
}
# How a due date is told.
OVERDUE = ("到期日未知", "已逾期 {} 天", "距到期还有 {} 天（尚未到期）")


def filled(template: str, field: Callable[[str], Column]) -> Column:
    """The template with the fields' texts in place of their names."""
    parts = []
    for text, name, *_ in Formatter().parse(template):
        parts += [F.lit(text)] * bool(text) + ([field(name)] if name else [])
    return F.concat(*parts)


def _each(items: Column, template: str) -> Column:
    return F.transform(items, lambda x: filled(template, lambda _: x))


def scene_queries(intent: Column, as_of: str, total: Column, count: Column, fresh: Column | None = None, flags: Column | None = None) -> tuple[Column, Column]:
    """(queries, hint) for a bill and the scene of a question: an array of texts and one text; none
    and an empty one for another intent.

    ``total`` and ``count`` are of the batch that the bill is in, ``fresh`` its new endorsers, and
    ``flags`` structs with code and description. Absent texts are empty; amounts have two decimals
    where they are not rounded to whole ones; the first query of a scene has no blanks at its ends.
    """
    flags = F.col("flags") if flags is None else flags
    fresh = F.col("endorsers") if fresh is None else fresh
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    number = lambda c: F.format_number(F.coalesce(c, F.lit(0.0)), 0)
    names = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    days = F.datediff(F.col("due_date").cast("date"), F.lit(as_of).cast("date"))
    told = lambda form, n: filled(form.replace("{}", "{n}"), lambda _: n.cast("string"))
    one = lambda c: F.when(E.present(c), F.array(F.col(c))).otherwise(F.array().cast("array<string>"))
    subjects = F.concat(one("drawer"), names(F.col("endorsers")))
    question = F.create_map(*(F.lit(x) for pair in FLAG_QUESTIONS.items() for x in pair))
    lists = {
        "named_acceptor": one("acceptor"), "named_drawer": one("drawer"), "endorsers": names(F.col("endorsers")), "new_endorsers": names(fresh),
        "flag_questions": F.filter(F.transform(flags, lambda f: F.try_element_at(question, f["code"])), lambda q: q.isNotNull()),
    }
    fields = {
        **{c: text(c) for c in ("ticket_type", "acceptor", "drawer", "drawer_bank")},
        "period": F.when(days.isNotNull(), E.period_label(days)).otherwise(""), "days": F.coalesce(days.cast("string"), F.lit("None")), "tier": E.amount_tier(F.col("amount_numeric")), "total_tier": E.amount_tier(total),
        "amount": F.coalesce(E.plain("amount_numeric"), F.lit("None")), "whole_amount": number(F.col("amount_numeric")), "whole_total": number(total), "bill_count": count.cast("string"),
        "overdue": F.when(days.isNull(), OVERDUE[0]).when(days < 0, told(OVERDUE[1], -days)).otherwise(told(OVERDUE[2], days)),
        "n_subjects": F.size(subjects).cast("string"), "subjects": F.array_join(subjects, ", "), "n_flags": F.size(flags).cast("string"),
        "flag_texts": F.when(F.size(flags) > 0, F.array_join(F.transform(flags, lambda f: f["desc"]), "；")).otherwise("无"),
        "new_list": F.when(F.size(names(fresh)) > 0, F.concat(F.lit("['"), F.array_join(names(fresh), "', '"), F.lit("']"))).otherwise("[]"),
    }
    queries, hint = F.array().cast("array<string>"), F.lit("")
    for name, (each, always, else_, about) in SCENES.items():
        listed = [_each(lists[c], form) for c, form in each.items()]
        asked = F.concat(*listed, F.array(*(E.stripped(filled(q, fields.get)) for q in always)).cast("array<string>"))
        if else_:
            asked = F.when(F.size(asked) == 0, F.array(*map(F.lit, else_))).otherwise(asked)
        queries = F.when(intent == name, asked).otherwise(queries)
        hint = F.when(intent == name, filled(about, fields.get)).otherwise(hint)
    return queries, hint

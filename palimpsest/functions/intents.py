"""What a question is after, and how memories are shown to a model."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words of each intent, in the order in which intents are tried.
INTENTS = {
    "episodic": "上次 之前 刚才 曾经 什么时候 哪天 几号 那天 最近 最近一次 前几天 上周 上个月 具体 详细 原话 怎么说的 怎么说 记得 还记得 我说 我说过 我提过 "
    "那次 那个 这件事 那件事 这个事 怎么做的 如何做的 步骤 流程 过程",
    "semantic": "我喜欢 我讨厌 我想要 我不喜欢 我爱 我烦 习惯 通常 一般 平时 老是 总是 推荐 适合我 我需要 我要找 偏好 更喜欢 最喜欢 比较好",
    "reflection": "总结 学到 收获 心得 体会 感悟 总的来说 整体上 概括 简述 进展 进步 提升 改善 变化 做了什么 完成了 做完了",
}
# Words of questions about long ago, and of those that ask for details (a blank follows all but the last).
HISTORICAL = "很久以前 很久之前 好久以前 好久之前 几个月前 半年前 一年前 年前 多年前 去年 前年 早年 当初 最初 刚开始 第一次 最早 最开始的 原始的 所有 全部 完整 全部历史 历史记录 从头到尾 整个过程 来龙去脉"
DETAIL = "上次 |之前 |记得 |具体 |原话 |怎么说的 |还记得"


def intent(question: Column) -> Column:
    """The first intent of which a word occurs, or ``default``; null counts as empty."""
    text, found = F.coalesce(question, F.lit("")), F.lit("default")
    for name, words in reversed(INTENTS.items()):
        found = F.when(text.rlike(words.replace(" ", "|")), name).otherwise(found)
    return found


def asks_details(question: Column) -> Column:
    """(H51)"""
    return F.coalesce(question, F.lit("")).rlike(DETAIL)


def historical(question: Column) -> Column:
    """(H52)"""
    return F.coalesce(question, F.lit("")).rlike(HISTORICAL.replace(" ", "|"))


def memory_line(kind: Column, similarity: Column, weight: Column, content: Column) -> Column:
    """A memory as a line of a prompt; a missing number is N/A, and a blank content gives null."""
    shown = lambda x, form: F.coalesce(F.when(x.isNotNull(), F.format_string(form, x)), F.lit("N/A"))
    head = F.concat(F.lit("["), F.upper(F.coalesce(kind, F.lit("unknown"))), F.lit("] (sim: "), shown(similarity, "%.3f"), F.lit(", imp: "), shown(weight, "%.2f"), F.lit(") "))
    return F.when(F.btrim(content) != "", F.concat(head, content))

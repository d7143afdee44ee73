"""What a question asks for, by rules alone: flags, classes, failure causes, date answers. All stay in the JVM.

Every pattern is also valid in the checking SQL: no look-around.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Words of small talk and of travel, looked for in lower-cased questions.
CHITCHAT = ("你好", "您好", "hi", "hello", "hey", "谢谢", "感谢", "再见", "拜拜", "你是谁", "你能做什么", "天气", "几点", "在吗")
TOURISM = (
    "旅游", "旅行", "景点", "景区", "攻略", "游记", "文化", "历史", "民俗", "非遗", "博物馆", "古镇", "门票", "美食", "酒店", "打卡",
    "风土人情", "习俗", "泼水节", "北欧", "傣族", "路线", "行程", "省份", "城市", "地区", "国家", "一日游", "两日游",
)

#: The pattern of each flag.
PATTERNS = {
    "follow_up": r"^(那|它|他|她|这个|那个|这些|那些|还有|再|另外|其他|此外|那么|其次|然后)|呢[?？]?$",
    "knowledge": r"什么是|是什么|为什么|什么意思|如何|怎么|怎么样|是谁|有哪些|解释|含义|由来|起源|区别",
    "off_domain": (
        r"手机|平板|笔记本|台式机|电脑配置|显卡|处理器|芯片|内存条|硬盘|相机|镜头|耳机|音箱|无人机|智能手表|手环|充电宝|路由器|"
        r"手机测评|数码测评|发布会|新机|旗舰机|原神|王者荣耀|和平精英|英雄联盟|蛋仔派对|第五人格|明日方舟|崩坏三|星穹铁道|我的世界|光遇|"
        r"手游|端游|网游|打游戏|电子游戏|游戏(版本|好玩|测评|攻略|榜单|更新)"
    ),
    "plan": r"规划|帮我安排|安排一下|行程安排|路线安排|旅游计划|旅行计划|出行计划|几日游|一日游|两日游|三日游|四日游|五日游|\d+\s*天\s*\d*\s*晚|怎么玩",
    "plan_word": (
        r"行程|规划|路线|自由行|旅游计划|旅行计划|出行计划|几日游|一日游|两日游|三日游|四日游|五日游|六日游|七日游|\d+\s*天|\d+\s*晚|"
        r"[一二两三四五六七八九十半几数]{1,3}\s*天|[一二两三四五六七八九十半]{1,3}\s*晚|怎么玩|接下来"
    ),
    "arrange": r"怎么安排|如何安排|怎样安排|怎么规划|如何规划|安排几天|安排一下",
    "cross_city": r"从\s*[一-龥]{2,10}\s*(?:出发)?\s*(?:去|到|前往)\s*[一-龥]{2,10}",
    "transport_change": (
        r"换(成|坐|乘|用)|改(坐|乘|用)|不想(开车|驾车|自驾|坐车)|不(想|要)自驾|(开车|驾车|自驾)(太|好|真)(累|麻烦|辛苦|远|久|慢)|"
        r"公共交通|坐(高铁|动车|火车|飞机|大巴)|乘(高铁|动车|火车|飞机|大巴)"
    ),
    "weather": r"天气|下雨|台风|暴雨|降雨|气温|温度|热不热|冷不冷|穿什么|防晒|适合出行|适合旅游|适合玩",
    "date_word": r"(几月几号|几号|多少号|几点钟?|星期几|周几|礼拜几|什么日期|日期|时间)",
    "activity": r"出发|到达|抵达|开门|关门|营业|闭园|闭馆|开始|结束|集合|发车|起飞|降落|检票|演出|上班|下班|上课|下课|关门",
    "date_anchor": r"今天|今日|现在|目前|当前|此刻|明天|明日|后天|大后天|昨天|昨日|前天|今晚|明晚",
    "clock": r"(现在|目前|此刻)?几点钟?|几点了|现在时间|什么时间|时间是多少",
    "festival": r"元旦|春节|元宵节?|情人节|妇女节|植树节|清明节?|劳动节|青年节|儿童节|建党节|建军节|七夕节?|中元节|教师节|国庆节|中秋节|重阳节|腊八节|圣诞节|除夕",
    "deixis": r"^(那边|那里|这边|这里|当地|此地)",
    "tweak": (
        r"(再|又|多|追加|增加|加|缩减|减少|少|改|换成|调|去掉|删掉).{0,4}(一|两|二|三|四|五|\d+)?\s*(天|晚|日|夜)|第[一二三四五六七八九十\d]+[天日]|"
        r"(太赶|太满|太紧|轻松点|紧凑点|预算|少花|砍半|省钱)"
    ),
    "correction": r"(我要去的是|我说的是|去的是|说的是|应该是|其实是)|，\s*不是|，\s*错了|，\s*不对|搞错|弄错|说错了|写错了|看错了",
    "confusion": (
        r"^[?？!！~～。.、\s]{1,6}$|^(什么意思|你说什么|啥意思|没听清|没听懂|没明白|不理解|不对吧|错了吧|为什么不对|"
        r"再说一遍|能再说一次|什么鬼|怎么回事|在说什么|啥|嗯？|啊？)[?？!！]?$"
    ),
    "consult": r"(可以吗|可以么|行不行|行吗|能不能|可不可以|合适吗|可行吗|是否可行|靠谱吗|允许吗)",
    "hub": (
        r"(?:机场|高铁站?|火车站|车站|客运站|码头|北站|南站|东站|西站)[^。？?]{0,12}(?:怎么|如何|怎样)(?:到|去|前往|回)|"
        r"(?:机场|高铁站?|火车站|车站|客运站|码头|北站|南站|东站|西站)\s*(?:到|去|前往)\s*(?:市区|市中心|城区|市里)|"
        r"(?:我在|到了?|抵达)[^。？?]{0,14}(?:机场|高铁站?|火车站|车站|客运站|码头|北站|南站|东站|西站)"
    ),
    "downtown": r"到市区|去市区|到市中心|到城区|进市区|市区里|市内怎么|市内交通",
    "several_days": r"回程|返程|回去|(?:\d+|[一二两三四五六七八九十]+)\s*(?:天|晚)|(?:几|哪)[天晚]|天行程|日游",
}

#: Causes of a failure by the words that point to them, in the order in which they are tried.
CAUSES = {
    "retrieval": ("召回", "检索", "chunk", "向量", "bm25", "rerank", "未召回", "召回错", "没找到", "搜不到"),
    "context": ("上下文", "记忆", "历史", "压缩", "截断", "忘了", "记错"),
    "prompt": ("格式", "instruction", "拒答", "指令遵循", "json", "输出格式"),
    "data": ("过期", "时效", "知识库", "源数据", "版本", "旧了", "已更新"),
    "tool": ("工具", "高德", "天气", "路线", "铁路", "api", "调用失败", "超时"),
    "ontology": ("标签", "实体", "类型", "分类", "分错"),
    "safety": ("越权", "脱敏", "泄露", "权限"),
    "product": ("前端", "页面", "按钮", "体验", "界面"),
}
REWRITES = ("不是", "改成", "换成", "改为", "应该是", "错了", "不对", "我要去", "重新", "纠正")
ABANDONS = ("算了", "不用了", "不聊了", "换个话题", "不要了")
CONNECTORS = ("那", "再", "它", "她", "他")
SHORT = 18

#: Names of days, festivals of fixed date and of the lunar calendar, words for other days.
WEEKDAYS = ("周一", "周二", "周三", "周四", "周五", "周六", "周日")
FESTIVALS = (
    ("元旦", 1, 1), ("情人节", 2, 14), ("妇女节", 3, 8), ("植树节", 3, 12), ("劳动节", 5, 1), ("青年节", 5, 4), ("儿童节", 6, 1), ("建党节", 7, 1),
    ("建军节", 8, 1), ("教师节", 9, 10), ("国庆节", 10, 1), ("圣诞节", 12, 25),
)
LUNAR = (
    ("春节", "正月初一"), ("元宵节", "正月十五"), ("元宵", "正月十五"), ("端午节", "五月初五"), ("七夕节", "七月初七"), ("七夕", "七月初七"), ("中元节", "七月十五"),
    ("中秋节", "八月十五"), ("重阳节", "九月初九"), ("腊八节", "腊月初八"), ("除夕", "除夕（农历腊月最后一天）"),
)
OTHER_DAYS = (("大大后天", 4, "大大后天"), ("大后天", 3, "大后天"), ("后天", 2, "后天"), ("明天", 1, "明天"), ("明日", 1, "明天"), ("昨天", -1, "昨天"), ("昨日", -1, "昨天"), ("前天", -2, "前天"))
ASKS = {"date": r"几月几号|几号|多少号|什么日期|日期", "weekday": r"星期几|周几|礼拜几", "clock": r"几点钟?|几点了|现在时间|什么时间|时间是多少"}

#: Names of a city's middle that are no place by themselves; the box that holds the country.
GENERIC = ("市区", "市中心", "城区", "城中心", "县城", "主城区")
LATITUDES, LONGITUDES = (15.0, 55.0), (70.0, 140.0)


def flag(name: str, text: Column | str) -> Column:
    return F.coalesce(col(text).rlike(PATTERNS[name]), F.lit(False))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def rule_class(text: Column | str) -> Column:
    """chitchat or tourism by the first rule that hits, or an empty text: small talk, travel words, products outside, questions for knowledge, plans."""
    lower = F.lower(F.coalesce(col(text), F.lit("")))
    return (
        F.when(_any(lower, CHITCHAT), "chitchat").when(_any(lower, TOURISM), "tourism").when(flag("off_domain", text), "chitchat")
        .when(flag("knowledge", text), "tourism").when(flag("plan", text), "tourism").otherwise("")
    )


def plan_signal(text: Column | str) -> Column:
    """A word that defines a plan, or a request to arrange something between two cities."""
    return flag("plan_word", text) | (flag("arrange", text) & flag("cross_city", text))


def date_question(text: Column | str) -> Column:
    """Whether the clock alone can answer: asks for a date or time, of no activity, and says which day, or asks for the hour or a festival."""
    return flag("date_word", text) & ~flag("activity", text) & (flag("date_anchor", text) | flag("clock", text) | flag("festival", text))


def expands(question: Column | str, subjects: Column | str, short: int = 15) -> Column:
    """Whether a question is searched by rewrites as well: it is not short, and no subject is confirmed."""
    return (F.length(F.coalesce(col(question), F.lit(""))) >= short) & (F.coalesce(F.size(col(subjects)), F.lit(0)) <= 0)


def transfer_question(text: Column | str) -> Column:
    """From a station or airport into town, without several days."""
    return flag("hub", text) & flag("downtown", text) & ~flag("several_days", text)


def cause(text: Column | str) -> Column:
    """The first cause whose words occur, else "data"."""
    lower = F.lower(F.coalesce(col(text), F.lit("")))
    first, *rest = CAUSES.items()
    out = F.when(_any(lower, first[1]), first[0])
    for name, words in rest:
        out = out.when(_any(lower, words), name)
    return out.otherwise("data")


def feedback(text: Column | str, previous: Column | str) -> Column:
    """rewrite, abandon or follow_up, or null; the last two only after an earlier question."""
    q, after = F.trim(F.coalesce(col(text), F.lit(""))), F.coalesce(col(previous), F.lit("")) != ""
    return (
        F.when(q == "", None).when(_any(q, REWRITES), "rewrite").when(after & _any(q, ABANDONS), "abandon")
        .when(after & (F.length(q) <= SHORT) & F.substring(q, 1, 1).isin(*CONNECTORS), "follow_up")
    )


def _weekday(day: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(day) + 1)


def _day(day: Column, year: bool = True) -> Column:
    parts = [F.month(day).cast("string"), F.lit("月"), F.dayofmonth(day).cast("string"), F.lit("日")]
    return F.concat(*([F.year(day).cast("string"), F.lit("年")] if year else []), *parts)


def date_answer(text: Column | str, now: Column) -> Column:
    """The answer of the clock to a date question: festivals first, then the day asked for, its weekday and the time."""
    q, today, year = F.coalesce(col(text), F.lit("")), F.to_date(now), F.year(now).cast("string")
    out = F.when(q.contains("清明"), F.concat(F.lit("清明节是二十四节气之一，一般落在公历4月4日至6日之间（"), year, F.lit("年具体日期以日历为准）。")))
    for name, month, day in sorted(FESTIVALS, key=lambda f: -len(f[0])):
        date = F.make_date(F.year(now), F.lit(month), F.lit(day))
        out = out.when(q.contains(name), F.concat(year, F.lit(f"年{name}是"), _day(date, year=False), F.lit("，"), _weekday(date), F.lit("。")))
    for name, lunar in sorted(LUNAR, key=lambda f: -len(f[0])):
        out = out.when(q.contains(name), F.concat(F.lit(f"{name}是农历{lunar}，"), year, F.lit("年对应的公历日期请以日历为准。")))
    offset, anchor = F.lit(0), F.lit("今天")
    for word, days, name in reversed(OTHER_DAYS):
        offset, anchor = F.when(q.contains(word), days).otherwise(offset), F.when(q.contains(word), name).otherwise(anchor)
    target = F.date_add(today, offset)
    asked = {name: q.rlike(pattern) for name, pattern in ASKS.items()}
    date = F.concat(anchor, F.lit("是"), _day(target))
    days = (
        F.when(asked["date"] & asked["weekday"], F.concat(date, F.lit("，"), _weekday(target), F.lit("。"))).when(asked["date"], F.concat(date, F.lit("。")))
        .when(asked["weekday"], F.concat(anchor, F.lit("是"), _weekday(target), F.lit("。"))).otherwise("")
    )
    clock = F.when(asked["clock"], F.concat(F.lit("现在是"), F.date_format(now, "HH:mm"), F.lit("。"))).otherwise("")
    plain = F.concat(F.lit("今天是"), _day(today), F.lit("，"), _weekday(today), F.lit("。"))
    return out.otherwise(F.coalesce(F.nullif(F.concat(days, clock), F.lit("")), plain))


def date_table(day: Column) -> Column:
    """A day, its weekday and the names of the fourteen days after it, by natural weeks."""

    def named(k: Column) -> Column:
        d = F.date_add(day, k)
        left = 7 - F.weekday(day)  # days to the next Monday
        name = F.when(k == 1, "明天").when(k == 2, "后天").when(k < left, _weekday(d)).when(k < left + 7, F.concat(F.lit("下"), _weekday(d))).otherwise(F.concat(F.lit("下下"), _weekday(d)))
        return F.concat(name, F.lit("="), F.date_format(d, "MM-dd"))

    days = F.transform(F.sequence(F.lit(1), F.lit(14)), named)
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), _weekday(day), F.lit("；未来14天："), F.array_join(days, "，"))


def generic_place(name: Column | str) -> Column:
    """Whether a name, bare of all but Chinese characters, is only that of a city's middle."""
    return F.coalesce(F.regexp_replace(col(name), "[^一-龥]", "").isin(*GENERIC), F.lit(False))


def in_box(latitude: Column | str, longitude: Column | str) -> Column:
    return F.coalesce(col(latitude).between(*LATITUDES) & col(longitude).between(*LONGITUDES), F.lit(False))

"""Values of the place lexicon, without code."""

# Names and words that must be these for right results.

#: Kinds of documents that name places, and the relation that chunks of other kinds fill.
SOURCE_KINDS = ("景点信息", "景区介绍")
RELATION_KEYS = {"酒店信息": "nearby_attractions", "文化知识介绍": "related_attractions", "游记攻略": "attractions", "线路推荐": "attractions"}

#: Words of headings.
STRUCTURE_WORDS = (
    "景点", "景区", "推荐", "结构", "概览", "逻辑", "建议", "时长", "人群", "决策", "优先级", "差异", "展开", "安排", "核心", "层", "天数", "游客", "旅行", "旅游", "攻略", "指南", "注意", "费用", "交通", "住宿",
    "美食", "线路", "行程", "玩法", "体验", "价值", "误区", "参考", "总结", "简介", "介绍", "特点", "文化", "风俗", "礼仪", "信息", "清单", "问答", "评论", "提示", "必备", "须知", "技巧", "预算",
)

#: Words of scenes and experiences.
GENERIC_WORDS = (
    "漫游", "慢游", "观光", "度假", "休闲", "海湾", "离岛", "本岛", "海岛", "古城", "古镇", "老城", "街区", "湖景", "海景", "夜景", "风景", "景观", "雪山", "山地", "山水", "拍照", "摄影", "散步", "打卡", "出片",
    "民宿", "酒店", "特产", "自由行", "串联", "门户", "到访", "首次", "节奏", "氛围", "元数据", "结语", "引言", "前言", "序言", "目录", "附录", "亮点", "特色", "榜单", "排行", "名单", "说明", "背景", "表格", "海边",
    "市区", "湾区", "轮渡", "亲子", "情侣", "古典", "厚重", "好玩", "小众", "宝藏", "秘境", "景色", "看海",
)

#: Parts of half sentences.
SENTENCE_MARKS = (
    "的", "怎么", "为什么", "如何", "适合", "值得", "值不值", "要不要", "是否", "一定", "必须", "不能", "可以", "需要", "最后", "解决", "越", "最", "还是", "不要", "分别", "相关", "常见", "以上", "喜欢", "想要", "适合谁", "值得吗",
)

#: Ends of figures of speech for cities, and of loose areas.
METAPHOR_ENDS = ("之城", "之都", "威尼斯", "之珠", "之滨")
AREA_ENDS = ("线", "区", "圈")

#: Words that are no terms by themselves, and ends that go.
NOISE_WORDS = ("周边", "附近", "全区", "全城", "市内")
AROUND_ENDS = ("方向", "片区", "周边", "区域", "一带", "附近", "所在")
WRAPPING = "｜|·・-—:：\"'“”‘’"

PROVINCES = (
    "河北", "山西", "辽宁", "吉林", "黑龙江", "江苏", "浙江", "安徽", "福建", "江西", "山东", "河南", "湖北", "湖南", "广东", "广西", "海南", "四川", "贵州", "云南", "陕西", "甘肃", "青海", "内蒙古", "宁夏", "新疆",
    "西藏", "台湾", "香港", "澳门",
)

CITIES = (
    "北京", "上海", "天津", "重庆",
    "杭州", "南京", "苏州", "无锡", "常州", "南通", "扬州", "镇江", "徐州", "连云港", "宁波", "温州", "绍兴", "嘉兴", "湖州", "金华", "台州", "舟山", "丽水", "衢州", "合肥", "黄山", "芜湖", "安庆", "福州", "厦门",
    "泉州", "漳州", "莆田", "武夷山", "南昌", "九江", "景德镇", "赣州", "上饶", "济南", "青岛", "烟台", "威海", "泰安", "曲阜", "日照", "临沂", "潍坊", "淄博",
    "广州", "深圳", "珠海", "佛山", "汕头", "潮州", "揭阳", "肇庆", "惠州", "湛江", "中山", "东莞", "韶关", "清远", "南宁", "桂林", "北海", "柳州", "阳朔", "海口", "三亚", "琼海", "万宁", "陵水", "儋州", "香港", "澳门",
    "武汉", "宜昌", "襄阳", "恩施", "荆州", "长沙", "张家界", "岳阳", "衡阳", "株洲", "常德", "凤凰", "郑州", "洛阳", "开封", "安阳", "焦作", "新乡",
    "石家庄", "秦皇岛", "承德", "张家口", "保定", "唐山", "太原", "大同", "平遥", "忻州", "呼和浩特", "包头", "鄂尔多斯", "呼伦贝尔", "赤峰",
    "沈阳", "大连", "丹东", "锦州", "长春", "吉林", "延吉", "哈尔滨", "牡丹江", "齐齐哈尔", "漠河", "伊春",
    "成都", "绵阳", "乐山", "峨眉山", "九寨沟", "稻城", "宜宾", "泸州", "南充", "康定", "西昌", "昆明", "大理", "丽江", "香格里拉", "西双版纳", "腾冲", "玉溪", "曲靖", "保山", "贵阳", "遵义", "安顺", "荔波", "镇远", "凯里",
    "拉萨", "林芝", "日喀则", "昌都",
    "西安", "咸阳", "宝鸡", "延安", "汉中", "榆林", "兰州", "敦煌", "张掖", "嘉峪关", "天水", "武威", "西宁", "格尔木", "银川", "中卫", "乌鲁木齐", "喀什", "伊犁", "阿勒泰", "吐鲁番", "哈密", "库尔勒",
)

#: Names of regions that are no places to go to.
REGIONS = ("中国", "全国", "全区", "全省", "南方", "北方", "西部", "东部", "欧洲", "亚洲", "非洲", "美洲", "全球", "世界", "国内", "国外")

#: Patterns: lines that name topics, headings, what separates terms.
TOPIC_LINE = r"(?mdU)^\s*[-*]?\s*主题\s*[：:]\s*(.+?)\s*$"
HEADING_LINE = r"(?mdU)^\s{0,3}#{2,6}\s*(.+?)\s*$"
BETWEEN_TERMS = r"(?U)[、，,／/｜|（）()\[\]【】\s]+|和|与|及"

#: Characters that end a clause from the third on, verbs before a place, what goes behind it, and what no place has.
CLAUSE_ENDS = "的或与及需乘要可请并也还再将会能把被让使至往从以及、，,。：:；;！!？?（）()[]【】/→~骑散逛"
PLACE_AFTER = r"(?:游览|参观|前往|抵达|游玩|漫步|打卡|逛逛|逛一逛|登上|乘船游览|夜游)\s*([一-龥A-Za-z0-9·\-]{2,12})"
PLACE_TAIL = "(后|附近|一带|等地|等|区域|景区内|周边)$"
NOT_A_PLACE = (
    "的|交通|住宿|餐饮|预算|行程|安排|建议|信息|说明|提示|注意事项|自由活动|购物|休息|骑行|散步|漫步|游览|品尝|欣赏|观看|体验|打卡|前往|抵达|游玩|返程|出发|需|乘|"
    r"或|与|及|、|，|,|。|（|）|\(|\)|:|：|/|→|~"
)
PLACE_LONGEST = 10

#: What asks for a booking.
BOOKING = "(帮|替|给)我?[^。？！?!]{0,15}(订|预订|预定|购买|买下)|代订|代办"

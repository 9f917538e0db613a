"""Fixed values. These must stay as they are for results to be right."""

# Whitespace stripped from cells and list items.
WHITESPACE = " \t\n\r\u000b\u000c\u0085\u00a0\u2002\u2003\u2009\u202f\u3000"

# Cell texts that mean "empty".
EMPTY_WORDS = ("nan", "none", "null", "-")

# Any of these separates list items in a profile cell.
LIST_SEPARATORS = r"[,，、;；/／\|｜]+"
PEER_SEPARATORS = r"[;；\n]+"
PEER_INSIDE_SEPARATORS = r"[,，、]"

FREQUENCIES = ("weekly", "monthly", "quarterly", "yearly", "rare")
DEFAULT_FREQUENCY = "yearly"
FREQUENCY_SPELLINGS = {
    "weekly": ("w", "weekly", "每周", "周"),
    "monthly": ("m", "monthly", "每月", "月"),
    "quarterly": ("q", "quarterly", "每季", "季"),
    "yearly": ("y", "yearly", "每年", "年"),
    "rare": ("r", "rare", "极少", "少"),
}

# Provenance of an edge; a higher number is never overwritten by a lower one.
SOURCE_PRIORITY = {"manual": 2, "colleague_inferred": 1, "ai_inferred": 0}
DEFAULT_STRENGTH = 3
COLLEAGUE_STRENGTH = 4
COLLEAGUE_CONTEXT = "同事"
COLLEAGUE_FREQUENCY = "monthly"

# Profile sheet headers.
H_NAME = "姓名"
H_NOTES = "备注"
H_STRENGTH = "可信度（言行一致性0-5分）"
H_CONTEXT = "职务"
H_PEERS = "认识"
H_COMPANY = "公司"
H_CITY = "城市"
H_NEED = "潜在需求"
H_INDUSTRY = "所属行业"
H_FEATURE = "AI标准化特征"
H_RESOURCE = "资源类型"
H_VALUE = "合作价值（0-5）"
H_VALUE_ALIAS = "合作价值评分（0-5）"
H_CORE_TAG = "核心标签（机构自营；机构fof；私募fof；三方机构；家办；个人；券商渠道）"
H_AMOUNT = "单笔可投资金额"
H_RISK = (
    "风险承受能力激进（可接受高回撤，追求高收益）、平衡（兼顾收益与风险）、"
    "稳健（低回撤优先，收益次之）"
)
H_WINWIN = (
    "共赢性（长：动机纯粹、追求长期共赢、中：有短期诉求，不排斥长期、"
    "短：动机不纯、仅追求短期利益）"
)
H_STAGE = (
    "关系阶段（A：有良好合作基础；B：未合作但熟悉；C：未合作且不熟悉；"
    "D:合作过但结果较差）"
)
H_INTEREST = "兴趣偏好"
H_HOUSEKEEPING = ("序号", "id", "ID")

# Label in the composed profile text -> header it comes from.
BIO_PARTS = (
    ("行业", H_INDUSTRY),
    ("职务", H_CONTEXT),
    ("公司", H_COMPANY),
    ("城市", H_CITY),
    ("合作价值", H_VALUE),
    ("可投金额", H_AMOUNT),
    ("风险偏好", H_RISK),
    ("共赢性", H_WINWIN),
    ("关系阶段", H_STAGE),
    ("兴趣偏好", H_INTEREST),
)

# Relations sheet: accepted header names per field, first present wins.
RELATION_HEADERS = {
    "a": ("甲", "A", "源", "source", "name_a"),
    "b": ("乙", "B", "target", "name_b"),
    "strength": ("强度", "strength"),
    "context": ("关系", "context", "描述"),
    "frequency": ("频率", "frequency"),
}

# Industry buckets in order of precedence: label, keywords, colour.
INDUSTRIES = (
    ("投资金融", ("私募", "公募", "基金", "投资", "券商", "银行", "信托", "FOF", "资管", "投行",
              "投顾", "金融", "理财", "财富"), "#5f756f"),
    ("技术研发", ("IT", "技术", "工程师", "算法", "开发", "AI", "数据", "互联网", "芯片", "半导体",
              "软件", "码农"), "#6d6a7e"),
    ("政府国资", ("政府", "国资", "处长", "科长", "局", "委", "事业单位", "公务员", "国企"), "#8f8365"),
    ("销售渠道", ("销售", "客户", "渠道", "BD", "市场", "营销", "经理", "分公司"), "#8b6f73"),
    ("创业老板", ("老板", "创业", "私营", "合伙人", "CEO", "创始人", "董事", "总经理", "总裁"), "#8f765e"),
    ("学术研究", ("研究", "教授", "博士", "院士", "学者", "学术"), "#5f6f82"),
    ("医疗大健康", ("医院", "医疗", "药", "医师", "护士", "器械", "生物"), "#5e7568"),
    ("制造地产", ("制造", "工厂", "产业", "建筑", "地产", "建材"), "#636b78"),
)
OTHER_INDUSTRY = ("其他", "#747882")
ME_INDUSTRY = ("我", "#f7f8f8")

# Geographic words that are not cities.
NOT_CITIES = (
    "中国", "全国", "海外", "国内", "境外", "亚洲", "欧洲", "北美",
    "华东", "华南", "华北", "西南", "西北", "东北", "中部",
)

# Judge roles and their weights.
ROLE_WEIGHTS = {"本人": 1.0, "桥梁": 0.5, "无关": 0.05}
DEFAULT_ROLE = "无关"

# Well-known mergers, renames and abbreviations: canonical -> other spellings.
BUILTIN_ALIASES = {
    "国泰海通证券": ("国泰君安", "国泰海通", "国泰君安证券", "海通证券", "国君", "国君证券"),
    "申万宏源证券": ("申万宏源", "申银万国", "宏源证券"),
    "中金公司": ("中国国际金融", "中国国际金融股份有限公司", "中金"),
}

# Reciprocal-rank fusion.
RRF_K = 60
CHANNEL_WEIGHTS = {"vector": 1.5, "helper": 1.5, "topic": 0.3}

# Evaluation categories of the golden set.
GOLDEN_CATEGORIES = ("role-cliff", "ambiguous", "longtail", "one-hop")

# Feedback form rules.
TITLE_LENGTH = (10, 40)
WHEN_THEN = r"(?i)当.*的时候.*希望|when.*then"
BULLET = r"(?m)^\s*([-*]|\d+\.)\s+\S"
FEEDBACK_TYPES = ("bug", "feature")
SEVERITIES = ("blocking", "daily", "nice")
BUG_HISTORY = ("new", "recent", "always")
IMAGE_TYPES = ("image/png", "image/jpeg", "image/gif", "image/webp")

# Personal data patterns; a word boundary counts letters of every script.
WORD_START = r"(?<![\p{L}\p{N}_])"
WORD_END = r"(?![\p{L}\p{N}_])"
ID_NUMBER = r"\d{17}[\dXx]"
CARD_NUMBER = r"\d{16,19}"
PHONE_NUMBER = r"(1\d{2})\d{4}(\d{4})"
EMAIL = r"([A-Za-z0-9])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})"

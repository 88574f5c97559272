"""Keyword tables and labels.

Operators take these as parameters; the tables below are the defaults.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Results are only right when these equal the published tables.
# ---------------------------------------------------------------------------

POSITIVE_TERMS = {
    "零碳园区": 10, "低碳园区": 8, "绿色园区": 6, "经济技术开发区": 2, "经开区": 2,
    "工业园区": 2, "产业园区": 1, "节能降碳": 6, "能碳管理": 6, "碳核算": 5,
    "碳排放": 3, "碳计量": 5, "碳足迹": 3, "工业共生": 6, "绿电直连": 5,
    "源网荷储": 5, "虚拟电厂": 4, "微电网": 4, "余热": 3, "余压": 3, "余冷": 3,
    "蒸汽系统": 3, "空压": 3, "电机节能": 3, "水回用": 3, "固废综合利用": 3,
    "绿色制造": 2, "绿色工厂": 3, "清洁能源": 2, "储能": 2, "绿电": 2,
    "节能改造": 4, "能效": 2, "减排": 2, "能源管理": 2,
}
NEGATIVE_TERMS = {
    "词元驱动": 10, "智能经济": 7, "脑机接口": 6, "量子科技": 5, "6g": 5,
    "低空装备": 5, "人才引进": 5, "科技创新生态": 6, "创新创业大赛": 6,
    "招商推介": 3, "文旅": 5, "赛事": 5, "消费券": 5, "党建": 4, "干部任免": 6,
    "采购公告": 4, "比选公告": 4, "招聘": 6, "表彰": 3, "会议通知": 2,
}
IMPLEMENTATION_TERMS = ["投产", "开工", "改造", "项目", "投资", "减排", "节能量", "装机", "回收", "利用率", "能效", "示范", "建成", "运行"]
NATIONAL_RULE_TERMS = ["标准", "核算", "指标体系", "零碳园区", "节能降碳"]
ON_TOPIC_TERMS = ["园区", "开发区", "经开区", "节能", "碳", "能源", "绿色制造", "工业共生"]
CATEGORY_RULES = [
    ("技术与设施", ["余热", "余压", "余冷", "热泵", "电机", "空压", "蒸汽", "凝结水", "水回用", "固废", "节能改造", "绿色工厂", "储能", "微电网", "虚拟电厂", "源网荷储", "分布式光伏", "设备更新"]),
    ("数据与评估", ["能碳管理", "碳核算", "排放因子", "碳计量", "监测平台", "碳足迹", "数据平台", "计量体系", "评价", "评估", "指标体系", "标准研究", "白皮书"]),
    ("项目与投融资", ["开工", "投产", "签约", "投资", "招标", "融资", "专项债", "绿色贷款", "合同能源管理", "项目清单"]),
    ("园区建设", ["零碳园区", "低碳园区", "绿色园区", "经开区", "经济技术开发区", "开发区", "工业园区", "产业园区", "园中园", "建设方案", "创建", "培育", "示范"]),
    ("政策与标准", ["通知", "意见", "办法", "规划", "标准", "指南", "行动计划", "实施方案", "征求意见", "管理办法"]),
]
CATEGORY_GUARDS = {"项目与投融资": ["开工", "投产", "签约", "投资", "招标", "融资", "项目清单"]}
DEFAULTABLE_CATEGORIES = ["园区建设", "技术与设施", "政策与标准", "数据与评估", "项目与投融资"]
CATCH_ALL_CATEGORY = "其他重要动态"
DIGEST_ORDER = ["园区建设", "技术与设施", "政策与标准", "数据与评估", "项目与投融资", "其他重要动态"]
BOARD_ORDER = ["园区建设", "技术与设施", "项目与投融资", "政策与标准", "数据与评估", "其他重要动态"]
TARGET_SHARE = {"园区建设": 0.35, "技术与设施": 0.25, "政策与标准": 0.15, "数据与评估": 0.15, "项目与投融资": 0.10}
SCOPE_VALUES = ["国家", "地方", "园区", "行业", "研究"]
NATIONAL_SOURCES = ["国家发展改革委", "国家能源局", "工业和信息化部", "生态环境部", "商务部", "中国政府网", "国务院", "国家标准化"]
PARK_SOURCES = ["开发区", "园区", "管委会"]
LOCAL_SOURCES = ["省发展改革委", "省能源局", "市发展改革委", "经济技术开发区", "高新技术产业开发区", "管委会", "人民政府", "省", "市", "自治区", "新区"]
USAGE_NOTES = {
    "园区建设": "用于核对建设范围、实施主体和进展；涉及绩效时仍需园区台账。",
    "技术与设施": "作为设施改造和项目储备线索；投资、节能量和减排量需可研或测量验证。",
    "政策与标准": "用于更新适用条件、核算规则和监管要求，并核对生效日期与适用对象。",
    "数据与评估": "用于更新数据字段、核算口径和评估方法；正式使用需保留版本与原始凭证。",
    "项目与投融资": "用于识别项目条件、实施主体和资金线索；收益与风险需基于项目参数复核。",
    "其他重要动态": "用于公开信息跟踪；正式评价前需核对对象、边界、年份和原始材料。",
}
EXCLUDED_NOTE = "与园区降碳建设的直接关联不足，不进入首页和周报；原记录保留在审计档案。"
REASON_HIT, REASON_WEAK = "命中“%s”", "弱相关“%s”"
REASON_IMPLEMENTATION = "含实施或量化线索"
REASON_PARK = "来自园区公开来源"
REASON_NATIONAL = "国家级规则来源"
REASON_OFF_TOPIC = "缺少园区或降碳直接语义"
REASON_NONE = "未命中零碳园区核心主题"

TITLE_TOKENS = ["（试行）", "(试行)", "征求意见稿", "正式发布", "权威发布"]
TITLE_EDGE_CHARS = " -—–_丨|｜:：·"
TITLE_PREFIX_PATTERN = r"^\s*(?:部门图解|政策图解|一图读懂|图解|视频|音频|答记者问|文字实录|新闻发布会|权威解读)\s*[丨|｜:：·—-]*\s*"
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "spm", "from", "source"]
TRUE_WORDS = ["1", "true", "yes", "y", "是", "已确认", "confirmed"]
PREFERRED_PATHS = ["/tz/", "/ywtz/", "/zcfg/", "/zwgk/", "/xxgk/"]
LINK_KEYWORDS = [
    "零碳园区", "低碳园区", "经济技术开发区", "经开区", "绿色园区", "节能降碳", "绿电直连", "源网荷储", "能碳管理",
    "工业共生", "绿色低碳", "碳排放双控", "节能改造", "余热利用", "绿色制造", "零碳工厂", "碳计量", "能源管理",
]

THEME_TERMS = {
    "计量与能碳管理": ["计量", "能碳", "平台", "监测", "管理系统"],
    "设备与系统节能": ["空压", "电机", "泵", "风机", "蒸汽", "余热", "余压", "热泵"],
    "清洁供能": ["光伏", "绿电", "储能", "微电网", "源网荷储", "氢能"],
    "资源循环": ["再生水", "水回用", "固废", "副产物", "工业共生", "循环利用"],
    "交通与物流": ["重卡", "充换电", "物流", "交通"],
    "项目与资金": ["投资", "补贴", "申报", "合同能源", "融资", "项目清单"],
}
QUANTITY_PATTERN = r"(?:\d+(?:\.\d+)?)\s*(?:%|亿元|万元|万千瓦|千瓦|MW|MWh|GWh|tCO.?|吨|万吨|公里|小时|年)"
IMPLEMENTATION_CATEGORIES = ["园区建设", "技术与设施", "项目与投融资"]
POLICY_CATEGORY = "政策与标准"

GATE_FIELDS = [
    ("park_name", "园区标准名称", "园区管委会", "正式园区名称及唯一标识", "text"),
    ("boundary_confirmed", "核算边界", "园区管委会/自然资源", "批复四至、红线图或GIS文件", "flag"),
    ("enterprise_list_confirmed", "纳入企业清单", "园区管委会/市场监管", "企业名称、统一社会信用代码、行业及纳入状态", "flag"),
    ("baseline_year", "基准年", "园区统计/发改", "明确统计年度并与全部活动数据一致", "nonzero"),
    ("energy_tce", "综合能源消费量", "发改/统计/园区", "分能源品种台账、折标系数及汇总表", "nonzero"),
    ("scope1_tco2", "范围一排放", "重点企业/园区", "燃料和过程活动数据、排放因子及计算底稿", "present"),
    ("scope2_tco2", "范围二排放", "供电/供热/园区", "购售电热台账、绿电凭证和排放因子版本", "present"),
    ("process_tco2", "工业过程排放", "重点企业", "碳酸盐分解、化学反应或其他过程活动数据", "present"),
]
BOARD_GATE_FIELDS = [
    ("boundary_confirmed", "法定边界", "园区管委会/自然资源", "边界图、批复文件和纳入范围说明", "flag"),
    ("enterprise_list_confirmed", "纳入企业清单", "园区管委会/市场监管", "企业名称、统一社会信用代码、行业和纳入状态", "flag"),
    ("baseline_year", "基准年", "园区统计/发改", "与全部活动数据一致的自然年", "nonzero"),
    ("energy_tce", "综合能源消费量", "发改/统计/园区", "分品种台账与折标底稿", "present"),
    ("scope1_tco2", "范围一排放", "重点企业/园区", "燃料活动数据与因子", "present"),
    ("scope2_tco2", "范围二排放", "供电/供热/园区", "购售电热、绿电凭证和因子版本", "present"),
    ("process_tco2", "工业过程排放", "重点企业", "过程活动数据；无过程排放时填0并说明", "present"),
]
GATE_PRIORITY, GATE_DUE = "P0", "3个工作日"
CORE_METRIC = "单位能耗碳排放"
PRODUCT_METRIC = "园区企业产出产品单位能耗"
PRODUCT_TARGET_TEXT = "达到或优于二级能耗限额；不适用时说明"
GUIDE_METRICS = [
    ("clean_energy_pct", "清洁能源消费占比", 90.0),
    ("solid_waste_pct", "工业固体废弃物综合利用率", 80.0),
    ("waste_energy_pct", "余热/余冷/余压综合利用率", 50.0),
    ("water_reuse_pct", "工业用水重复利用率", 80.0),
]
PRODUCT_OK = ["达标", "达到", "优于", "不适用"]
BOARD_CORE_METRIC, BOARD_PRODUCT_METRIC = "单位综合能耗碳排放", "产品单位能耗"
BOARD_GUIDE_METRICS = [
    ("clean_energy_pct", "清洁能源消费占比", 90.0),
    ("solid_waste_pct", "工业固废综合利用率", 80.0),
    ("waste_energy_pct", "余热/余冷/余压综合利用率", 50.0),
    ("water_reuse_pct", "工业用水重复利用率", 80.0),
]
SCALE_NOTES = [
    "综合能源消费量20万—100万吨标准煤",
    "综合能源消费量100万吨标准煤及以上",
    "综合能源消费量低于20万吨标准煤；国家试行指标中的核心阈值需结合申报要求确认",
]
OPEN_STATUSES = ["未达到", "缺数据", "未完成判断", "待确认"]
RISK_STATUSES = ["未达到", "缺数据", "未完成判断"]
BOARD_RISK_STATUSES = ["未达到", "缺数据", "需确认适用阈值"]

BASIC, CONDITIONAL, SPECIAL = "基础改进型", "条件实施型", "专项论证型"
SCREEN_CONDITIONAL = ["光伏", "绿电", "储能", "微电网", "热泵", "电锅炉", "电窑炉", "氢"]
SCREEN_BASIC = ["计量", "能碳管理", "电机", "泵", "风机", "空压", "蒸汽", "凝结水", "余热", "水回用", "维护", "工业共生"]
BOARD_BASIC = ["计量", "能碳管理", "电机", "泵", "风机", "空压", "蒸汽", "凝结水", "余热", "余压", "水回用", "维护", "工业共生"]
TIER_CONDITIONAL = ["绿电", "储能", "微电网", "光伏", "热泵", "电锅炉", "电窑炉", "氢", "CCUS", "原料替代", "药剂替代"]
TIER_BASIC = ["计量", "能碳管理", "电机", "泵", "风机", "空压", "蒸汽系统", "凝结水", "维护", "水回用", "工业共生", "余热回收"]
TIER_CONSTRAINTS = ["产品质量", "工艺安全", "改造空间", "并网", "电网容量"]
GREEN_POWER_TERMS = ["绿电", "储能", "微电网", "光伏"]
GREEN_POWER = "绿电"
ANY_INDUSTRY = "全部"
GAP_TERMS = {
    "单位能耗碳排放": ["计量", "能碳管理", "电机", "泵", "风机", "空压", "蒸汽", "余热", "工艺优化", "能源管理"],
    "园区企业产出产品单位能耗": ["电机", "泵", "风机", "空压", "蒸汽", "炉窑", "工艺优化", "设备更新", "能效"],
    "清洁能源消费占比": ["分布式光伏", "绿电", "储能", "微电网", "源网荷储", "热泵", "电气化"],
    "工业固体废弃物综合利用率": ["固废", "工业共生", "副产物", "资源化", "循环利用"],
    "余热/余冷/余压综合利用率": ["余热", "余压", "余冷", "热泵", "蒸汽", "凝结水"],
    "工业用水重复利用率": ["水回用", "再生水", "废水", "循环水", "中水"],
}
FALLBACK_METRICS = ["单位能耗碳排放", "园区企业产出产品单位能耗"]
OWNER_TERMS = [
    ("计量", "园区管委会、公共设施运营方、重点用能企业"),
    ("能碳管理", "园区管委会、能源运营方、重点用能企业"),
    ("电机", "重点用能企业"),
    ("空压", "重点用能企业"),
    ("蒸汽", "热力运营方、用汽企业"),
    ("余热", "能源运营方、供热企业、用热企业"),
    ("水回用", "水务运营方、用水企业"),
    ("固废", "园区管委会、产废企业、资源化企业"),
    ("工业共生", "园区管委会、上下游企业"),
    ("绿电", "能源运营方、用电企业、电网企业"),
    ("储能", "能源运营方、用电企业"),
    ("光伏", "园区业主、能源运营方、用电企业"),
]
DEFAULT_OWNER = "园区管委会、相关设施运营方和实施企业"
BOARD_GAP_MAP = [
    ("单位综合能耗碳排放", ["电机", "泵", "风机", "空压", "蒸汽", "余热", "能碳管理"], "先降低单位能源消耗和高耗能系统损失"),
    ("清洁能源消费占比", ["光伏", "绿电", "储能", "微电网"], "在源荷、网架和结算条件核清后提高低碳供能比例"),
    ("产品单位能耗", ["电机", "空压", "工艺", "数字", "余热"], "围绕主要产品基准线开展设备与工艺改造"),
    ("工业固废综合利用率", ["固废", "副产物", "工业共生", "资源"], "建立副产物流向、品质和稳定需求清单"),
    ("余热/余冷/余压综合利用率", ["余热", "余压", "热泵", "蒸汽"], "先做热源—热汇匹配和年度运行小时核算"),
    ("工业用水重复利用率", ["水回用", "再生水", "污水", "循环水"], "从水量平衡和水质分级利用入手"),
]
BOARD_FALLBACK = ("在正式差距数据形成前，先核查计量、设备效率和资源循环等基础事项", "数据前置")

SENSITIVITY = [
    ("保守情景", 1.15, 0.80, 1.10, 0.90, "投资上浮15%，节省下降20%，运维上浮10%，减排下降10%"),
    ("基准情景", 1.00, 1.00, 1.00, 1.00, "按当前录入参数"),
    ("改善情景", 0.95, 1.10, 1.00, 1.05, "投资下降5%，节省上升10%，减排上升5%"),
]
UNNAMED_OWNER = "待明确"
BOARD_OWNERS = {"绿色供能": ["能源运营方", "用能企业"], "资源循环": ["公共设施运营方", "园区企业"], "管理基础": ["园区管委会", "园区企业"]}
BOARD_DEFAULT_OWNERS = ["园区企业"]
STAGES = ["减碳", "近零碳", "零碳（需核验剩余排放与抵消）"]
DEMO_WORDS = ["demonstration", "demo", "演示"]
WEAK_EVIDENCE = ["指南级", "示例", "演示", "演示参数", "low", ""]
CONCLUSIONS = {
    "demo": "演示场景仅用于验证计算链路，不构成园区可行性结论",
    "not_ready": "暂不具备正式可行性测算条件",
    "high": "具备初步测算基础，但关键风险尚未关闭",
    "medium": "具备初步可行性，需通过专项可研和参数核验后决策",
    "clear": "具备较完整的初步可行性条件",
}
BOARD_MEDIUM_CONCLUSION = "具备初步可行性，需专项可研和参数核验"

DOMESTIC = "国内园区"
PEER_POINTS = [("industry", 5, "产业类型相同"), ("boundary_type", 2, "建设边界相同"), ("level", 2, "名单层级相同"), ("province", 1, "同省"), ("period_year", 1, "启动年份接近")]
MAP_VIEWS = [("全国", 72.0, 136.5, 17.0, 54.5), ("国家级", 72.0, 136.5, 17.0, 54.5), ("广东", 108.8, 118.2, 19.0, 26.2), ("全球", -180.0, 180.0, -58.0, 84.0)]
FUNNEL = [
    ("园区名录对象", "具有标准名称和唯一标识的园区或国际案例"),
    ("滚动公开记录", "经规范URL去重的政策、园区和技术记录"),
    ("园区公开证据", "可以关联到具体园区、但仍需核对口径的材料"),
    ("核验后公共事实", "完成来源与对象核验的名单、政策或宏观事实"),
    ("正式核算园区", "同边界、同年度、活动数据和排放数据均完整"),
]
ALL_FACET = "全部"
HEADLINES = {
    "kpi": [
        ("国内园区", "domestic_parks", None), ("国际案例", "international_cases", None), ("有效公开记录", "archive_records", None),
        ("待准备字段", "required_fields", None), ("减排设施指南", "technology_measures", None), ("可正式核算园区", "formal_accounting_ready", None),
    ],
    "quality": [
        ("进入公开页", "archive_records", "included"), ("合并重复", "duplicates_collapsed", "duplicates_collapsed"),
        ("排除低相关", "excluded_low_relevance", "excluded_low_relevance"), ("可正式核算", "formal_accounting_ready", None),
    ],
}
HEALTH_LABELS = [("healthy", "正常"), ("failed", "失败"), ("watch", "观察"), ("quarantined", "隔离"), ("unknown", "未检查")]

# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class RelevanceRules:
    """Everything the curation projection needs to know about a subject."""

    positive: dict = field(default_factory=lambda: POSITIVE_TERMS)
    negative: dict = field(default_factory=lambda: NEGATIVE_TERMS)
    implementation: list = field(default_factory=lambda: IMPLEMENTATION_TERMS)
    national_terms: list = field(default_factory=lambda: NATIONAL_RULE_TERMS)
    on_topic: list = field(default_factory=lambda: ON_TOPIC_TERMS)
    categories: list = field(default_factory=lambda: CATEGORY_RULES)
    guards: dict = field(default_factory=lambda: CATEGORY_GUARDS)
    minimum_score: int = 4

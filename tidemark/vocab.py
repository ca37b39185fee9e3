"""Controlled vocabularies and text formats.

Everything here is a default; every operator takes its vocabulary as a parameter.
"""

# ---- fixed values: names and relation keywords of the change graph -------------
YEAR_MARK = "年"
BOUNDARY_WORD = "城市边界"
EVENT_WORD = "边界事件"
ENTER_WORD = "进入"
EXIT_WORD = "退出"
KEYWORDS_ADJACENT = "ADJACENT_TO, 地理相邻"
KEYWORDS_TRANSITION = "TRANSITION_FROM, 时间演变"
KEYWORDS_ON_BOUNDARY = "ON_BOUNDARY, 事件归属边界"
KEYWORDS_INVOLVES = "INVOLVES_POINT, 空间事件"
KEYWORDS_HAS_GOAL = "HAS_GOAL, 政策目标"
KEYWORDS_HAS_MEASURE = "HAS_MEASURE, 政策措施"
EVENT_TYPE = "STTE_Event"
DEFAULT_POINT_TEXT = "地理点"
NO_DESCRIPTION = "(无描述)"
NO_EVIDENCE = "(未检索到结构化证据)"
NO_CHUNKS = "(未检索到相关文档片段)"
NONE_WORD = "无"
POLICY_QUERY_PREFIX = "政策文档相关内容: "
IMAGE_PREFIX = "【图表描述】\n"

# ---- fixed values: point card fields, (column, label) in order ------------------
POINT_PLACE_FIELDS = (("district", "行政区"), ("sub_district", "街道"), ("planning_zone", "规划片区"))
POINT_USE_FIELDS = (("planning_function", "功能"), ("land_use_code", "用地"),
                    ("point_type", "类型"), ("control_line", "控制线"))

# ---- fixed values: vocabulary of the extracted graph ----------------------------
ENTITY_TYPES = ("Policy", "PolicyGoal", "PolicyMeasure", "District", "Infrastructure",
                "SpatialConcept", "Indicator")
RELATION_TYPES = ("HAS_GOAL", "HAS_MEASURE", "ACHIEVES", "LOCATED_IN", "PART_OF", "APPLIES_TO",
                  "TARGETS", "CONSTRAINS", "SUPPORTS", "MENTIONS")
SENTENCE_TYPES = ("PolicyGoal", "PolicyMeasure")
TYPE_PRIORITY = {"Policy": 7, "District": 6, "Infrastructure": 5, "SpatialConcept": 4,
                 "Indicator": 3, "PolicyGoal": 2, "PolicyMeasure": 1}
VERB_PREFIXES = ("撤销", "设立", "分设", "新设", "成立", "划定", "调整", "推进",
                 "建设", "打造", "形成", "构建", "拓展", "完善", "改造", "整治",
                 "提升", "实现", "保障", "落实", "强化", "深化", "实施", "开展")
CONNECTIVES = ("的", "和", "与", "及")

# ---- fixed values: type aliases --------------------------------------------------
ENTITY_TYPE_ALIASES = {
    "policy": "Policy", "plan": "Policy", "planning": "Policy",
    "policygoal": "PolicyGoal", "goal": "PolicyGoal", "target": "PolicyGoal", "strategy": "PolicyGoal",
    "district": "District", "city": "District", "zone": "District", "area": "District",
    "infrastructure": "Infrastructure", "transit": "Infrastructure", "road": "Infrastructure",
    "landuse": "LandUse", "residential": "LandUse", "industrial": "LandUse", "commercial": "LandUse",
    "政策": "Policy", "规划": "Policy", "规划文件": "Policy", "文件": "Policy",
    "目标": "PolicyGoal", "政策目标": "PolicyGoal",
    "区域": "District", "片区": "District", "城区": "District", "走廊": "District",
    "基础设施": "Infrastructure", "交通": "Infrastructure",
    "用地": "LandUse", "土地利用": "LandUse",
}
RELATION_TYPE_ALIASES = {
    "has_goal": "HAS_GOAL", "located_in": "LOCATED_IN", "plans_to": "PLANS_TO",
    "affects": "AFFECTS", "related": "RELATED",
    "影响": "AFFECTS", "包含": "HAS_GOAL", "位于": "LOCATED_IN", "规划": "PLANS_TO", "关联": "RELATED",
}

# ---- fixed values: rule extraction -----------------------------------------------
POLICY_NAME_PATTERN = r"([一-鿿A-Za-z0-9（）()《》\-]{2,40}(?:规划|方案|政策|纲要|计划|意见|通知))"
DISTRICT_PATTERN = r"([一-鿿]{2,18}(?:中心城区|新区|片区|组团|大走廊|区|县|市))"
INFRASTRUCTURE_TERMS = ("轨道交通", "综合交通枢纽", "交通枢纽", "铁路", "高速公路",
                        "地铁", "机场", "港口", "公园", "医院", "学校", "产业园")
LAND_USE_TERMS = ("工业用地", "居住用地", "商业用地", "生态用地", "建设用地",
                  "农业用地", "公共服务用地", "绿地")
GOAL_WORDS = ("目标", "打造", "建设", "推进", "提升", "优化")
GOAL_SENTENCE_BREAK = r"[。；;！!？?\n]"
NAME_MARKERS = ("提出建设", "规划建设", "重点建设", "建设", "打造", "推进", "优化", "完善",
                "提升", "布局", "形成")
LEADING_VERBS = ("提出", "建设", "打造", "推进", "优化", "完善", "提升", "布局", "形成")
QUOTED_POLICY_PATTERN = r"《([^》]{3,60})》"
FALLBACK_DISTRICTS = ("上城区", "拱墅区", "西湖区", "滨江区", "萧山区", "余杭区", "临平区",
                      "钱塘区", "富阳区", "临安区", "桐庐县", "淳安县", "建德市", "下城区", "江干区",
                      "钱江新城", "未来科技城", "城西科创大走廊", "之江新城", "大江东")
FALLBACK_INFRASTRUCTURE = ("杭州东站", "杭州西站", "萧山国际机场", "杭州地铁", "城市轨道",
                           "之江实验室", "良渚博物院")

# ---- fixed values: rule linking --------------------------------------------------
EXPANSION_WORDS = ("扩张", "增长", "发展", "建设", "拓展", "扩大", "提升", "打造")
MEASURE_RULES = (
    (("居住", "住宅", "住房", "居民", "安置"), ("居住", "R2")),
    (("产业", "制造", "工业", "数字", "科创"), ("产业", "创新", "制造", "数字", "M1")),
    (("商业", "商务", "商贸", "金融", "TOD"), ("商业", "金融", "商务", "TOD", "B1")),
    (("交通", "运输", "枢纽", "轨道", "地铁", "高铁"), ("交通", "枢纽", "轨道", "S（")),
    (("生态", "绿化", "公园", "绿地", "绿廊"), ("生态", "公园", "绿", "G1")),
    (("公共", "教育", "医疗", "文体", "服务"), ("公共", "教育", "医疗", "A（")),
)
TRANSPORT_NAME_WORDS = ("地铁", "轨道", "高铁", "交通")
TRANSPORT_POINT_WORDS = ("交通", "枢纽", "S（")

# ---- fixed values: heading numbering patterns and their levels --------------------
HEADING_PATTERNS = (
    (r"^第[一二三四五六七八九十百零〇\d]+[章篇]", 1),
    (r"^第[一二三四五六七八九十百零〇\d]+[节条]", 2),
    (r"^[一二三四五六七八九十]+、", 2),
    (r"^[（(][一二三四五六七八九十]+[）)]", 3),
    (r"^\d+(\.\d+){2,}\s", 3),
    (r"^\d+\.\d+\s", 2),
    (r"^\d+\s", 1),
)
SENTENCE_MARKS = "。！？；!?;"

# ---- fixed values: caption filters ------------------------------------------------
CAPTION_WORDS = (
    "规划", "用地", "空间", "边界", "开发", "建设", "保护",
    "生态", "红线", "耕地", "农田", "交通", "轨道", "地铁",
    "道路", "枢纽", "走廊", "片区", "组团", "城区", "新城",
    "中心", "功能", "结构", "布局", "格局", "战略", "目标",
    "指标", "面积", "人口", "规模", "比例", "增长率",
    "绿地", "公园", "水系", "河道", "流域",
    "公共", "服务", "设施", "配套", "市政",
    "产业", "工业", "商业", "居住", "住宅",
    "城镇", "乡村", "村庄", "农村", "城乡",
    "图例", "比例尺", "坐标", "图斑", "地块",
    "表", "数据", "统计", "趋势", "对比",
    "杭州", "浙江", "长三角",
)
CAPTION_REJECTS = (
    "这是一张", "这张图片", "该图片是", "图片显示",
    "照片", "实景", "拍摄", "摄影", "景观", "风景",
    "logo", "标志", "封面", "底图", "背景",
    "无法判断", "无法确定", "无法辨认", "无法识别", "看不清",
    "无法推导", "无直接标注", "没有明确",
    "无明确", "未涉及", "不包含", "未标注",
    "无城市规划", "无政策含义", "无空间边界",
)

# ---- fixed values: answer and error classes ---------------------------------------
HARD_FAIL_PHRASES = ("Waiting for tool calls", "(未检索到结构化证据)", "maximum iterations",
                     "max_iters", "reasoning-acting loop without finishing")
SOFT_FAIL_PHRASES = ("未找到相关信息", "未检索到")
TRANSIENT_ERROR_WORDS = ("timeout", "ratelimit", "rate limit", "429", "connection",
                         "remote disconnected", "econnreset", "503", "502", "504")

# ---- fixed values: question routing -----------------------------------------------
ROUTING = {
    "SpatialEventAgent": (
        "边界", "扩张", "收缩", "进入边界", "退出边界",
        "STTE", "空间事件", "空间变化", "空间模式", "相邻",
        "geography", "gis", "地图",
        "点位", "哪个点", "哪些点", "几个点", "多少个点",
    ),
    "GraphReasoningAgent": (
        "为什么", "原因", "因果", "推理", "关系",
        "驱动", "影响", "预测", "综合",
        "综合分析", "深度分析", "关联",
        "格局", "结构", "体系", "布局",
        "政策", "规划", "法规", "措施", "文件",
        "文档", "条文", "规定", "方案", "纲要",
        "规划目标", "政策文件", "全文", "原文",
        "特点", "特征", "是什么", "怎么样", "如何",
        "概念", "定义", "含义",
    ),
    "TemporalReasoningAgent": (
        "趋势", "变化趋势", "年均", "增长率", "时间序列",
        "逐年", "各年", "历年", "年度对比", "跨年",
        "对比.*年", "比较.*年", "从.*年到.*年",
        "演变", "演变过程", "发展过程", "时间线",
    ),
}
DEFAULT_ROUTE = "GraphReasoningAgent"
REPORT_PHRASES = ("撰写报告", "生成报告", "写报告", "出报告", "撰写分析报告", "生成分析报告", "分析报告")
CITATION_LABELS = {"空间分析": "SpatialEventAgent", "图谱推理": "GraphReasoningAgent",
                   "时间序列": "TemporalReasoningAgent"}

# ---- fixed values: topics ----------------------------------------------------------
CITY_PATTERN = r"(杭州|上海|北京|深圳|广州|成都|南京|苏州|武汉|西安|重庆|天津)|(?:[一-龥]{2,6}(?:市|区|县|镇))"
DOMAIN_TOPICS = (
    "边界", "扩张", "收缩", "土地利用", "用地", "规划", "政策", "交通",
    "人口", "经济", "产业", "空间格局", "空间", "时间序列", "趋势", "对比",
    "演变", "时间线", "点位", "GIS", "图谱", "驱动因素", "预测", "报告",
    "容积率", "建筑", "绿地", "规划区", "跨域",
)

# ---- fixed values: prices per million tokens ----------------------------------------
TOKEN_PRICES = {"input": 1.0, "output": 2.0, "cache_read": 0.1}

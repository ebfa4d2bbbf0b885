"""The patterns, labels and cue words of the detectors."""

from __future__ import annotations

from typing import NamedTuple

#: Unicode classes as elsewhere; only \\n ends a line.
FLAGS = "(?U)(?d)"
_L, _R = "(?<![0-9A-Za-z])", "(?![0-9A-Za-z])"
_FIRM = "(?:供应商[甲乙丙丁]?|规划设计院|设计院|研究院|事务所|工程局|咨询|评估|运营|服务|建设|贸易|开发|运维|机电|地产|钢构|租赁|资本|公司|集团|基金|证券|银行|保险|科技|实业|工程|劳务|材料|设备|装饰|建材|物资)"


class Rule(NamedTuple):
    rule_id: str
    label: str
    risk: str
    confidence: float
    pattern: str
    #: One of these stands in every text with a match; () if none is sure.
    anchors: tuple[str, ...] = ()
    group: int = 0


#: A search is fast where a pattern begins with a character, and what must not stand before it is told behind that; and where nothing is tried twice.
RULES = (
    Rule("phone_cn", "CONTACT", "high", 0.97, r"1(?<![0-9A-Za-z]1)[3-9]\d{9}" + _R),
    Rule("email", "CONTACT", "high", 0.96, r"(?<![\w.+-])[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}(?![\w.-])", ("@",)),
    Rule("landline_cn", "CONTACT", "high", 0.95, r"[0(（](?<![0-9A-Za-z.].)(?:(?<=0)\d{2,3}[- ]\d{7,8}|(?<=\()0\d{2,3}\)\s?\d{7,8}|(?<=（)0\d{2,3}）\s?\d{7,8})(?:转\d{1,5})?" + _R, ("0",)),
    Rule("org_credit_code", "ORG_CODE", "high", 0.95, r"(?:统一社会信用代码|信用代码)[:：\s]*([0-9A-Z]{18})", ("信用代码",), 1),
    Rule("uscc_bare", "ORG_CODE", "high", 0.90, _L + "(?=[0-9A-Z]*[A-Z])(?=[0-9A-Z]*[0-9])[0-9A-Z]{18}" + _R),
    Rule("id_card_cn", "ID_CARD", "critical", 0.96, _L + r"\d{6}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[0-9Xx]" + _R, ("19", "20")),
    Rule("contract_id", "CONTRACT_ID", "high", 0.96, r"编号[:：\s]*([A-Z0-9][A-Z0-9-]{6,})", ("编号",), 1),
    Rule("contract_id_meeting_or_case", "CONTRACT_ID", "high", 0.95, r"(?:会议号|案号)[:：\s]*([A-Z]{2,5}-\d{4}-[A-Z]{2,8}-\d{3,4})", ("会议号", "案号"), 1),
    Rule("contract_id_legal_item", "CONTRACT_ID", "high", 0.94, r"(?<![A-Z0-9-])([A-Z]{2,5}-\d{4}-[A-Z]{2,8}-\d{3,4})(?=项下)", ("项下",), 1),
    Rule("bank_account", "BANK_ACCOUNT", "high", 0.96, r"(?:收款账号|银行账号|开户账号|账户|账号|卡号|开户行)[^\d。；;\n]{0,20}?([0-9](?:[ -]?[0-9]){11,27})", ("账号", "账户", "卡号", "开户行"), 1),
    Rule("bank_card_number", "BANK_ACCOUNT", "high", 0.95, r"银行卡[:：\s]*([0-9](?:[ -]?[0-9]){11,27})", ("银行卡",), 1),
    Rule("amount_cny", "AMOUNT", "medium", 0.88, "|".join([*(c + r"\s*\d+(?:[,，]\d{3})*(?:\.\d{1,2})?\s*[万亿]?\s*元?" for c in ("人民币", "￥", "¥")), *(c + r"为\s*\d+(?:\.\d{1,2})?万元" for c in ("金额", "报价", "价款"))]), ("人民币", "￥", "¥", "金额", "报价", "价款")),
    Rule("amount_cny_unit", "AMOUNT", "medium", 0.85, r"\d(?<![\d.].)\d*+(?:[,，]\d{3})*+(?:\.\d++)?+\s*+[万亿](?!\s*(?:平\s*方\s*米|平\s*米|㎡|m²))(?:\s*元)?", ("万", "亿")),
    Rule("discount_rate", "DISCOUNT_RATE", "high", 0.90, r"下浮(?:率|比例)?\s*[为:：]?\s*(\d+(?:\.\d+)?\s*[%％])", ("下浮",), 1),
    Rule("date", "DATE", "medium", 0.90, r"\d{4}(?:年\d{1,2}月\d{1,2}日?|([-/.])\d{1,2}\1\d{1,2})"),
    Rule("url", "SYSTEM_URL", "high", 0.94, r"https?://[^\s，。；;、！？（）()【】《》“”‘’\"'「」]+", ("http",)),
    Rule("token_like", "CREDENTIAL", "critical", 0.93, r"[tTaAsSſhH](?i:(?<=t)oken|(?<=a)pi[_-]?key|(?<=s)ecret|(?<=h)r[_-]?key)\s*[:=]\s*((?i:[A-Za-z0-9_.=-]{16,}))", (":", "="), 1),
    Rule("aws_access_key", "CREDENTIAL", "critical", 0.97, _L + "AKIA[0-9A-Z]{16}" + _R, ("AKIA",)),
    Rule("github_token", "CREDENTIAL", "critical", 0.96, _L + "gh[pousr]_[A-Za-z0-9]{36,255}" + _R, ("gh",)),
    Rule("slack_token", "CREDENTIAL", "critical", 0.95, _L + "xox[baprs]-[0-9A-Za-z-]{10,255}" + _R, ("xox",)),
    Rule("live_api_key", "CREDENTIAL", "critical", 0.96, _L + "[sr]k_live_[0-9A-Za-z]{16,255}" + _R, ("k_live_",)),
    Rule("openai_like_key", "CREDENTIAL", "critical", 0.90, _L + "sk-(?:proj-)?[A-Za-z0-9_-]{20,255}" + _R, ("sk-",)),
    Rule("google_api_key", "CREDENTIAL", "critical", 0.96, _L + r"AIza[0-9A-Za-z_\-]{35}" + _R, ("AIza",)),
    Rule("jwt", "CREDENTIAL", "critical", 0.95, _L + r"eyJ[A-Za-z0-9_-]{8,1024}\.[A-Za-z0-9_-]{8,1024}\.[A-Za-z0-9_-]{8,1024}" + _R, ("eyJ",)),
    Rule("org_by_cue", "SUPPLIER", "high", 0.85, r"(?:供应商|分包方|分包队|劳务队|承包商|中标单位|监理单位|监理|对方|乙方|甲方|代表|委托)[为是:：]*\s*([㐀-鿿]{2,20}(?:有限公司|公司|集团|研究院|设计院|工程局|事务所|监理|物流|劳务|租赁|装饰|建材|物资|设备|咨询|证券|地产|机电|钢构|供应链|安保服务|服务|分包队|科技|实业|工程))", (), 1),
    Rule("enterprise_by_strong_cue", "SUPPLIER", "high", 0.84, r"(?:未登记(?:机构|主体|顾问|供应商|相对方)|未登记项目名|供应商|相对方|候选人来自未登记机构|来自未登记机构)[为是:：]?\s*([一-龥]{2,20}" + _FIRM + ")", ("未登记", "供应商", "相对方"), 1),
    Rule("enterprise_after_partner_cue", "SUPPLIER", "high", 0.83, r"与((?!(?:(?:商办|住宅|办公|商业|本|该)?(?:项目|地块|股权)|股同权|同股同权|进行|实施|后续))[一-龥]{2,20}" + _FIRM + r")(?=就|协商|洽谈|沟通|联络|核对|确认|结算|谈判|提交|对接|发生|报价|，|。)", ("与",), 1),
)
# Public regions and authorities, read only where a profile asks for them.
_REGION = r"(?:[一-龥]{2,8}(?:省|自治区|自治州|市|区|县)){1,3}"
_OFFICES = "规划和自然资源局|自然资源和规划局|自然资源局|发展和改革委员会|住房和城乡建设委员会|住房和城乡建设局|财政局|国资委"
PUBLIC = (
    Rule("public_region", "PUBLIC_REGION", "low", 0.96, _REGION, ("省", "自治", "市", "区", "县")),
    Rule("public_authority", "PUBLIC_AUTHORITY", "low", 0.97, f"{_REGION}(?:人民政府|{_OFFICES})|国务院|自然资源部|国土资源部|{_OFFICES}", ("政府", "局", "委", "部", "国务院")),
)
# Labels whose declared values may be broken by blanks, ends of sentences, and parts that a clipped name must not be.
FLEXIBLE = ("PROJECT_NAME", "DOCUMENT_NAME")
SENTENCE_ENDS = "。！？；"
CLIPPED_NAMES = ("公司", "有限公司", "有限责任公司", "股份公司", "股份有限公司", "份公司", "展有限公司", "开发有限公司", "总公司", "集团")
#: What begins or ends a private key, well framed or not; detect.private_keys puts the markers together.
PRIVATE_KEY_MARKER = r"(?i)-{2,}(?:BEGIN|END)[ \t]+(?:[A-Z0-9]+[ \t]+)?PRIVATE(?:[ \t]+KEY)?-*"
PRIVATE_KEY = Rule("private_key_block", "CREDENTIAL", "critical", 1.0, PRIVATE_KEY_MARKER)
#: Priority of a whole private key over all other spans.
PRIVATE_KEY_PRIORITY = 110
# Priorities of sources, of others, and what a rule adds from which confidence on.
SOURCES = {"manual": 100, "declared_value": 95, "session_mapping": 90, "dictionary": 80, "rule": 70, "public_context_rule": 70, "openai_privacy_filter": 55, "model": 50}
OTHER_SOURCE, SURE_RULE, SURE_RULE_BONUS = 40, 0.95, 5

# Signatures of injections and the general form of a secret.
INJECTION = {
    "ignore_instructions": r"(?i)ignore\s+(?:all\s+)?(?:the\s+)?(?:previous|prior|above|earlier)\s+(?:instructions?|prompts?|messages?|context|rules?)",
    "disregard_above": r"(?i)disregard\s+(?:all\s+)?(?:the\s+)?(?:previous|prior|above|earlier)",
    "forget": r"(?i)forget\s+(?:everything|all\s+(?:previous|prior)|what\s+(?:i|you)\s+(?:said|told))",
    "role_override": r"(?i)you\s+are\s+now\b|pretend\s+(?:to\s+be|you\s+are|that)|act\s+as\s+(?:if|a|an)\b",
    "reveal_system": r"(?i)(?:reveal|show|print|repeat|output|display)\s+(?:me\s+)?(?:your\s+)?(?:system\s+)?(?:prompt|instructions?|message|rules?)",
    "dev_mode": r"(?i)\b(?:developer\s+mode|jailbreak|do\s+anything\s+now|\bDAN\b)\b",
    "zh_ignore": r"(?:忽略|忽视|无视|不要理会|不用理会|不必理会)(?:掉|了)?(?:之前|上述|前面|以上|先前|所有|那些|系统|给你的)?.{0,20}?(?:指示|指令|提示词?|规则|要求|设定|限制)",
    "zh_reveal": r"(?:显示|输出|打印|重复|告诉我|说出)(?:你的|出你的)?.{0,12}?(?:系统)?(?:提示词?|指令|设定|规则)",
    "zh_roleplay": r"假装你是|扮演(?:一个|成)?|你现在是|从现在起你?是|进入开发者模式|越狱模式",
}
SECRET = r"(?i)(?:password|passwd|secret|token|api[_-]?key)[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9_/+=.-]{8,})"
#: Our own bounds: characters and bits of entropy from which on a value counts as a secret.
SECRET_LENGTH, SECRET_BITS = 12, 3.0

# Role sets with their cues, labels that take roles, characters in front that are searched.
ROLES = {
    "contract": {"PARTYA": "甲方|发包人|发包方", "PARTYB": "乙方|承包人|承包方", "GENCON": "总包|总承包", "SUBCON": "分包", "GUARANTOR": "担保人|保证人", "SUPERVISOR": "监理", "PRINCIPAL": "委托方|委托人"},
    "investment": {"LEAD": "牵头方|牵头投资|主投", "TARGET": "标的方|标的公司|投资标的|被投方|被投", "PARTNER": "合作方|合作伙伴|联合体", "INVESTOR": "投资方|投资人", "TRANSFEROR": "转让方|出让方", "TRANSFEREE": "受让方"},
}
ROLE_LABELS, ROLE_WINDOW = ("ORG", "SUPPLIER"), 10

# Short names in placeholders, forms of placeholders, areas.
PREFIXES = {"DEPARTMENT": "DEPT", "LAND_PARCEL": "PARCEL", "SYSTEM_URL": "URL", "RISK_JUDGMENT": "RISK", "INTERNAL_OPINION": "OPINION", "NEGOTIATION_POSITION": "POSITION"}
PLACEHOLDER = r"<[A-Z][A-Z0-9_]*_\d{3,}>"
ALTERED = (r"<[A-Z][A-Z0-9_]*[-_]\d{1,}>", r"<\s*[A-Za-z][A-Za-z0-9_]*\s*[-_]?\s*\d{1,}\s*>")
BARE_PLACEHOLDER = r"(?<!<)\b[A-Z][A-Z0-9_]*_\d{3,}\b(?!>)"
AREA = r"(?i)^\s*(?:平\s*方\s*米|平\s*米|㎡|m²)"
AREA_END = r"(?i)(?:平\s*方\s*米|平\s*米|㎡|m²)\s*$"
QUANTITY = r"(?i)^\s*\d+(?:[,，]\d{3})*(?:\.\d+)?\s*[万亿]?\s*(?:平\s*方\s*米|平\s*米|㎡|m²)?\s*$"

# Tails of names that a model cuts off, by label; characters at which a name stops; how far a tail is looked for.
ORG_TAILS = ("股份有限公司", "有限公司", "有限责任公司", "集团", "公司", "研究院", "设计院", "工程局", "事务所", "管理处", "管理局", "委员会", "办公室", "中心", "基金", "银行", "证券", "保险", "股权投资项目", "投资项目")
ADDRESS_TAILS = ("大厦", "大楼", "广场", "大道", "街道", "社区", "村委会", "基地", "号", "栋", "室", "座", "层")
NAME_STOPS = "的了是在与和及或为由对把被让向从到等将该其此之，。、；：！？,.;:!?\n\r\t （）()【】[]\"'《》"
TAIL_WINDOW = 12
# What ends a whole name before a line end, what a name over two lines ends in, and tails that begin a line.
WHOLE_ORGS = (*ORG_TAILS[:-2], "政府", "局", "部")
WRAPPED_ORGS = (*WHOLE_ORGS, "行政主管部门")
WRAPPED_ADDRESSES = ("省", "市", "区", "县", "路", "站", "街", "镇", "乡", "园", "城", *ADDRESS_TAILS)
NEXT_LINE_TAILS = ("股份有限公司", "有限责任公司", "有限公司", "工程局", "公司", "集团")
WRAPPED_AUTHORITY = "规划和自然资源"
# Names that a model gives but that name nobody, edges that aren't part of a name, predicates behind one.
NOBODY = {
    "ORG": ("公司", "限公司", "有限公司", "股份公司", "份公司", "项目公司", "管理委员会", "展有限公司", "开发有限公司", "行政机关", "人民政府", "国务院", "自然资源部", "国土资源管理部门", "人民政府土地管理部门", "城市规划、建设、房产管理部门", "行政主管部门"),
    "ADDRESS": ("地铁", "市", "区", "县"),
}
PUBLIC_TAILS = ("人民法院", "仲裁委员会", "仲裁院", "仲裁中心")
PUBLIC_FORMS = ("行政机关", "人民政府", "县人民政府土地管理部门", "市县人民政府国土资源行政主管部门", "人民政府国土资源行政主管部门", "直辖市人民政府", "国务院", "自然资源部", "国土资源部", "国土资源管理部门", "城市规划建设房产管理部门", "项目公司")
NAME_EDGES = " \t“”‘’\"'「」『』【】[]"
PREDICATE = "(?:有意|意向|计划|拟)?(?:收购|转让|退出|参与)|自行(?:决定|管理|运营)|负责(?:实施|管理|运营)?|按照"
REPEAT_WINDOW = 16

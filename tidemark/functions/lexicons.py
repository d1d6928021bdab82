"""Word lists of the news domain.

Fixed values: results depend on these exact words, weights and their order.
"""

SIGNAL_WORDS = (
    "退市", "退市新规", "立案调查", "重大违法", "破产", "业绩暴雷", "巨额亏损", "债务违约", "重大重组", "重大资产重组", "借壳", "并购", "涨停", "跌停", "监管处罚", "业绩超预期", "业绩预增", "业绩预减", "爆雷",
    "ST", "*ST", "龙虎榜", "机构净买入", "业绩预告", "降准", "降息", "加息", "印花税", "注册制", "产业政策", "补贴", "减税", "政策利好", "国常会", "证监会", "央行", "国务院", "政治局", "中央经济工作会议",
    "平准基金", "国家队", "汇金", "北向资金", "回购", "增持", "减持", "分红", "股权激励", "IPO", "定增", "可转债", "美联储", "鲍威尔", "欧央行", "非农", "汇率", "人民币贬值", "美元飙升", "日本央行", "日银",
    "植田", "日元", "套息", "套利交易", "美债收益率", "国债收益率", "收益率曲线", "利差", "期限利差", "逆回购", "MLF", "买断式逆回购", "SLF", "公开市场", "社融", "M2", "信贷", "离岸人民币", "美元指数",
    "人民币汇率", "中间价", "VIX", "波动率", "基差", "贴水", "融资余额", "两融", "融资融券", "CPI", "PPI", "通胀", "物价", "利率决议", "FOMC", "GDP", "失业率", "就业数据", "熔断", "暴跌", "崩盘",
    "债务危机", "银行危机", "金融风险", "战争", "军事冲突", "制裁", "地缘", "俄乌", "中东", "台海", "关税", "贸易战", "出口管制", "禁运", "原油暴跌", "原油暴涨", "油价", "韩指", "日经", "美股暴跌", "纳指",
    "算力", "科技股", "英伟达", "韩国", "中际旭创",
)
BROAD_SIGNAL_WORDS = (
    "央行", "国务院", "证监会", "政治局", "汇金", "国家队", "平准基金", "美联储", "鲍威尔", "欧央行", "中央经济工作会议", "韩国", "日经", "纳指", "美股", "科技股", "汇率", "油价", "北向资金", "机构净买入",
    "龙虎榜", "CPI", "PPI", "通胀", "物价", "利率决议", "FOMC", "GDP", "失业率", "就业数据",
)
OVERSEAS_TECH_WORDS = (
    "半导体", "芯片", "集成电路", "AI", "人工智能", "算力", "英伟达", "纳指", "科技股", "通信", "光模块", "CPO", "存储", "晶圆", "先进封装", "GPU", "PCB", "MLCC",
)
TECH_SECTOR_WORDS = (
    "半导体", "芯片", "集成电路", "算力", "AI", "人工智能", "英伟达", "存储", "光模块", "CPO", "PCB", "MLCC", "液冷", "散热", "服务器", "数据中心", "通信", "光通信", "消费电子", "机器人", "电子",
    "软件", "互联网", "科技", "GPU", "CPU", "晶圆", "封测", "先进封装", "智能驾驶", "卫星", "量子", "数据要素",
)
OVERSEAS_SOURCES = (
    "富途", "华尔街", "金十",
)
CREDIBILITY = {
    "上海证券交易所": 0.99, "深圳证券交易所": 0.99, "北京证券交易所": 0.98, "北交所": 0.98, "央视新闻": 0.96, "新华社": 0.96, "人民日报": 0.95, "经济日报": 0.94, "光明日报": 0.93, "证监会": 0.97,
    "央行": 0.97, "国务院": 0.97, "银保监会": 0.96, "国家发改委": 0.96, "中国证券报": 0.92, "上海证券报": 0.91, "证券时报": 0.9, "证券日报": 0.9, "财联社电报": 0.89, "财联社": 0.89,
    "第一财经": 0.87, "交易所龙虎榜": 0.98, "交易所业绩预告": 0.98, "同花顺快讯": 0.84, "新浪财经": 0.82, "东方财富快讯": 0.84, "东方财富": 0.83, "同花顺": 0.81, "和讯网": 0.8, "金融界": 0.8,
    "金十数据": 0.8, "Reuters": 0.88, "Bloomberg": 0.88, "Associated Press": 0.85, "Dow Jones": 0.85, "路透": 0.88, "彭博": 0.88, "美联社": 0.85, "中信证券": 0.78,
    "中金公司": 0.77, "海通证券": 0.75, "华泰证券": 0.74, "国泰君安": 0.74, "招商证券": 0.73, "广发证券": 0.72, "21世纪经济报道": 0.7, "财新网": 0.69, "界面新闻": 0.67, "企业自媒体报道": 0.42,
    "股吧": 0.33, "雪球": 0.38,
}
IMPACT_WEIGHTS = {
    "退市": 0.25, "立案调查": 0.25, "重大违法": 0.22, "破产重整": 0.25, "业绩暴雷": 0.22, "巨额亏损": 0.2, "债务违约": 0.2, "重大重组": 0.18, "借壳上市": 0.18, "并购": 0.15, "涨停": 0.12,
    "跌停": 0.12, "监管处罚": 0.15, "业绩超预期": 0.15, "业绩预增": 0.12, "业绩预减": 0.12, "ST": 0.1, "爆雷": 0.2, "跑路": 0.2, "熔断": 0.25, "暴跌": 0.2, "崩盘": 0.22,
    "债务危机": 0.2, "银行危机": 0.2, "金融风险": 0.18, "战争": 0.2, "军事冲突": 0.18, "冲突": 0.15, "制裁": 0.15, "地缘": 0.15, "关税": 0.15, "贸易战": 0.15, "出口管制": 0.15,
    "禁运": 0.18, "美联储": 0.15, "加息": 0.12, "降息": 0.12, "原油暴跌": 0.18, "原油暴涨": 0.18, "韩指": 0.18, "韩元": 0.15, "日元暴跌": 0.18, "CPI": 0.2, "PPI": 0.18,
    "通胀": 0.15, "物价": 0.12, "利率决议": 0.18, "FOMC": 0.18, "GDP": 0.15, "失业率": 0.15, "就业数据": 0.15, "美债": 0.12, "社融": 0.15, "LPR": 0.15, "PMI": 0.15,
    "日本央行": 0.18, "日银": 0.15, "植田": 0.15, "日元": 0.15, "套息": 0.2, "套利交易": 0.18, "美债收益率": 0.18, "国债收益率": 0.15, "收益率曲线": 0.15, "利差": 0.12, "期限利差": 0.12,
    "逆回购": 0.15, "MLF": 0.15, "买断式逆回购": 0.18, "SLF": 0.15, "公开市场": 0.12, "M2": 0.15, "信贷": 0.12, "离岸人民币": 0.15, "美元指数": 0.15, "人民币汇率": 0.15,
    "VIX": 0.18, "波动率": 0.12, "基差": 0.12, "贴水": 0.12, "融资余额": 0.12, "两融": 0.12, "融资融券": 0.12,
}
POLICY_WEIGHTS = {
    "降准": 0.2, "降息": 0.2, "加息": 0.15, "印花税": 0.22, "注册制": 0.15, "产业政策": 0.12, "补贴": 0.1, "减税": 0.12, "国务院": 0.12, "证监会": 0.1, "央行": 0.1,
    "国家发改委": 0.1, "政策利好": 0.12,
}
SECTOR_WORDS = (
    "半导体", "芯片", "新能源", "光伏", "储能", "人工智能", "AI", "大模型", "算力", "数据要素", "医药", "创新药", "白酒", "银行", "房地产", "军工", "稀土", "煤炭", "钢铁", "有色", "消费电子", "汽车",
    "锂电", "氢能", "机器人",
)
TECH_WORDS = (
    "CPO", "光模块", "光连接", "光通信", "硅光", "光电", "光芯片", "光互联", "PCB", "覆铜板", "线路板", "HDI", "柔性电路板", "FPC", "半导体", "芯片", "封测", "晶圆", "光刻", "EDA", "存储芯片",
    "集成电路", "闪存", "显存", "算力", "服务器", "交换机", "液冷", "散热", "GPU", "CPU", "HBM", "DDR5", "先进封装", "CoWoS", "混合键合", "TSV", "硅通孔", "英伟达", "AMD", "台积电",
    "海力士", "三星", "ASML", "中芯国际",
)
TECH_ABBREVIATIONS = (
    "CPO", "PCB", "HDI", "FPC", "EDA", "GPU", "CPU", "HBM", "DDR5", "CoWoS", "TSV", "ASML", "AMD",
)
MEDIUM_WORDS = (
    "北向资金", "外资", "机构调研", "回购", "增持", "减持", "分红", "股权激励", "IPO", "定增", "可转债", "研报", "评级", "目标价", "买入", "卖出",
)
NOISE_WORDS = (
    "庆典", "年会", "获奖", "表彰", "周年", "联谊", "晚会", "八卦", "娱乐", "明星", "综艺", "电影", "电视剧", "广告", "软文", "赞助", "冠名",
)
ANNOUNCEMENT_TIERS = (
    (("立案调查", "重大违法", "破产重整", "破产清算", "强制解散", "被接管", "移送司法"), 0.95),
    (("业绩预告", "业绩预增", "业绩预减", "业绩修正", "业绩扭亏", "业绩盈转亏", "重大资产重组", "借壳上市", "重大收购", "重大出售", "债务违约", "债务展期", "巨额亏损", "监管处罚", "行政处罚", "警示函", "监管措施", "股票停牌", "复牌"),
    0.82),
    (("并购", "收购", "重组", "定增", "非公开发行", "可转债", "回购", "增持", "减持", "股东减持", "董监高减持", "股权激励", "限制性股票", "员工持股计划", "分红", "派息", "送转", "高送转", "担保", "对外担保", "委托理财", "诉讼", "仲裁", "知识产权"),
    0.6),
    (("退市", "终止上市", "实施退市风险", "ST", "*ST", "股东大会", "召开股东大会", "通知召开", "增加临时提案", "变更会计政策", "变更会计师事务所", "变更保荐人", "募集资金", "募集资金使用", "募集资金存放", "章程修订", "制度修订", "治理结构", "投资者保护", "投资者回报"),
    0.35),
    (("投资者关系活动", "调研接待", "投资者交流", "日常公告", "更正公告", "补充公告", "勘误", "报送材料", "报备材料", "备案", "联系方式变更", "办公地址变更", "董事会决议", "监事会决议", "独董意见", "年报", "半年报", "季报", "一季报", "三季报", "定期报告", "报告全文"),
    0.12),
)
OFFICIAL_HOSTS = (
    "cninfo.com.cn", "sse.com", "sse.com.cn", "szse.cn", "hkexnews.hk", "sec.gov", "nasdaq.com", "nyse.com", "bse.cn",
)
OFFICIAL_LABELS = (
    "巨潮资讯", "上交所", "深交所", "港交所", "北交所", "上海证券交易所", "深圳证券交易所", "北京证券交易所", "香港交易所",
)
COMPANY_EVENT_WORDS = (
    "业绩预增", "业绩预减", "业绩扭亏", "业绩暴雷", "业绩预告", "并购", "重组", "借壳", "收购", "减持", "增持", "回购", "立案调查", "退市", "ST", "*ST", "涨停", "跌停", "重大合同", "中标", "签约",
    "债务违约", "监管处罚",
)
SECTOR_NEWS_WORDS = (
    "行业", "板块", "产业链", "龙头", "概念股", "赛道", "sector", "industry", "peers", "supply chain",
)
MACRO_NEWS_WORDS = (
    "大盘", "指数", "宏观", "央行", "利率", "通胀", "降准", "降息", "A股", "印花税", "注册制", "北向资金", "外资", "美股", "纳指", "标普", "道指", "纳斯达克", "港股", "恒生", "恒生科技", "南向资金",
    "日经", "日股", "韩指", "韩国", "KOSPI", "欧股", "德国DAX", "法国CAC", "英国富时", "美联储", "fed", "鲍威尔", "非农", "CPI", "PPI", "加息", "缩表", "QE", "点阵图", "欧央行", "日央行",
    "日本央行", "BOJ", "inflation", "战争", "冲突", "制裁", "地缘", "俄乌", "中东", "巴以", "台海", "朝鲜", "核武", "导弹", "无人机袭击", "军事", "政变", "恐怖袭击", "原油", "WTI", "布伦特",
    "油价", "黄金", "白银", "铜价", "铁矿石", "大宗商品", "有色金属", "暴跌", "熔断", "崩盘", "债务危机", "银行危机", "汇率", "美元", "美债", "日元", "人民币汇率", "金融风险", "系统性风险", "流动性危机", "关税",
    "贸易战", "出口管制", "禁运",
)
GLOBAL_RISK_WORDS = (
    "制裁", "出口管制", "禁运", "技术封锁", "实体清单", "关税", "贸易战", "美联储", "加息", "降息", "缩表", "QE", "鲍威尔", "非农", "熔断", "崩盘", "债务危机", "银行危机", "金融风险", "系统性风险", "原油暴涨",
    "原油暴跌", "战争", "军事冲突", "冲突", "地缘", "暴跌",
)
NATIONAL_SOURCES = (
    "央视新闻", "新华社", "人民日报", "经济日报", "光明日报", "证监会", "央行", "国务院", "银保监会", "国家发改委", "上海证券交易所", "深圳证券交易所", "北京证券交易所", "北交所", "中国证券报", "上海证券报", "证券时报",
    "证券日报",
)
NATIONAL_POLICY_WORDS = (
    "降准", "降息", "加息", "印花税", "注册制", "国务院", "央行", "证监会", "国家发改委", "货币政策", "财政政策", "宏观调控", "国家级", "人民银行", "外汇储备", "逆回购", "MLF", "LPR",
)
BULLISH_WORDS = (
    "撤销退市", "撤销*ST", "撤销ST", "撤销风险警示", "申请撤销", "摘帽", "扭亏为盈", "业绩扭亏", "扭亏", "业绩预增", "业绩超预期", "大幅预增", "大幅增长", "业绩大增", "股份回购", "大额回购", "回购股份", "股东增持",
    "董监高增持", "管理层增持", "中标", "签约", "大额订单", "重大合同", "降准", "降息", "减税降费", "减税", "政策利好", "产业扶持", "财政补贴", "并购重组", "重大资产重组", "借壳上市", "大涨", "暴涨", "飙升", "涨停",
    "涨幅显著", "涨幅扩大", "涨超", "普涨", "价格大涨", "价格暴涨", "价格飙升", "走高", "上行", "回升", "涨价", "上调目标价", "上调", "逆势上涨", "涨逾",
)
BEARISH_WORDS = (
    "立案调查", "重大违法", "破产重整", "破产清算", "被接管", "监管处罚", "行政处罚", "警示函", "监管措施", "监管问责", "业绩暴雷", "巨额亏损", "债务违约", "重大违约", "业绩预减", "业绩盈转亏", "首亏", "亏损扩大",
    "负增长", "退市", "终止上市", "实施退市风险", "*ST", "股东减持", "董监高减持", "大股东减持", "减持", "跌停", "大跌", "暴跌", "跳水", "重挫", "重创", "跌超", "走弱", "走低", "低开低走", "回调", "下滑",
    "下跌", "跌逾", "熔断", "逆势下跌", "下调", "价格大跌", "价格暴跌", "价格跳水", "产品降价", "下调目标价", "跑路", "爆雷", "行业利空", "出口管制", "制裁", "禁运", "断供", "贸易摩擦",
)
REVERSING_PREFIXES = (
    "放宽", "放松", "解除", "取消", "移除", "结束", "终止", "停止",
)
NEGATIONS = (
    "不", "未", "没", "无", "非", "勿", "莫", "没有", "未能", "不能", "不会", "不再", "无从", "取消", "终止", "撤销", "撤回", "中止", "停止", "废除", "解除", "失败", "拒绝", "否认", "否定",
    "驳回", "推翻",
)
SECTOR_NAMES = {
    "CPO": "CPO/光通信", "光模块": "CPO/光通信", "光连接": "CPO/光通信", "光通信": "CPO/光通信", "硅光": "CPO/光通信", "光芯片": "CPO/光通信", "光互联": "CPO/光通信", "PCB": "PCB/电路板",
    "覆铜板": "PCB/电路板", "线路板": "PCB/电路板", "HDI": "PCB/电路板", "柔性电路板": "PCB/电路板", "FPC": "PCB/电路板", "半导体": "半导体", "芯片": "半导体", "封测": "半导体", "晶圆": "半导体",
    "光刻": "半导体", "EDA": "半导体", "集成电路": "半导体", "存储芯片": "半导体", "闪存": "半导体", "显存": "半导体", "代工": "半导体", "算力": "算力/服务器", "服务器": "算力/服务器", "交换机": "算力/服务器",
    "液冷": "算力/服务器", "散热": "算力/服务器", "GPU": "算力/服务器", "CPU": "算力/服务器", "HBM": "存储/HBM", "DDR5": "存储/HBM", "先进封装": "半导体", "CoWoS": "半导体", "新能源": "新能源",
    "光伏": "光伏", "储能": "储能", "人工智能": "人工智能", "AI": "人工智能", "大模型": "人工智能", "数据要素": "数据要素", "医药": "医药", "创新药": "医药", "白酒": "白酒", "银行": "银行",
    "房地产": "房地产", "地产": "房地产", "军工": "军工", "稀土": "稀土", "煤炭": "煤炭", "钢铁": "钢铁", "有色": "有色金属", "消费电子": "消费电子", "汽车": "汽车", "锂电": "锂电池", "氢能": "氢能",
    "机器人": "机器人",
}
HIGH_IMPACT_ANNOUNCEMENTS = (
    "立案调查", "重大违法", "破产重整", "破产清算", "强制解散", "被接管", "业绩预告", "业绩预增", "业绩预减", "业绩修正", "业绩扭亏", "业绩盈转亏", "重大资产重组", "借壳上市", "重大收购", "重大出售", "债务违约", "债务展期",
    "巨额亏损", "监管处罚", "行政处罚", "警示函", "监管措施", "股票停牌", "复牌", "退市", "终止上市", "实施退市风险", "撤销退市", "撤销*ST", "撤销ST", "摘帽",
)
LEADER_CODES = (
    "688256", "688041", "300308", "300502", "002371", "603501", "300661", "688008", "002463", "300394", "002281", "688599", "688036", "688185",
    "300274", "688590", "300750", "688981", "601138", "600584",
)
LEADER_NAMES = (
    "寒武纪", "海光信息", "中际旭创", "新易盛", "北方华创", "韦尔股份", "圣邦股份", "澜起科技", "沪电股份", "天孚通信", "光迅科技", "传音控股", "阳光电源", "宁德时代", "中芯国际", "工业富联", "长电科技", "中兴通讯",
    "紫光国微", "兆易创新",
)
EVENT_GROUPS = (
    ("激励", ("股权激励", "股票激励", "激励计划", "限制性股票")),
    ("回购", ("回购",)),
    ("增持", ("增持",)),
    ("减持", ("减持",)),
    ("业绩预告", ("业绩预告", "业绩预增", "业绩预减", "业绩快报")),
    ("并购重组", ("并购", "重组", "收购")),
    ("定增", ("定增", "非公开发行", "定向增发")),
    ("分红", ("分红", "派息", "送转", "权益分派")),
    ("中标签约", ("中标", "签约", "大额订单", "重大合同")),
    ("立案处罚", ("立案", "处罚", "警示函")),
    ("退市", ("退市", "终止上市")),
    ("龙虎榜", ("龙虎榜", "机构净买入")),
    ("调研", ("投资者关系活动", "调研", "投资者交流")),
    ("行情下跌", ("走低", "盘前走低", "暴跌", "跌超", "下挫", "重挫", "走弱", "领跌", "跌停", "闪崩", "震荡走弱", "持续走低")),
)
MACRO_SUBJECTS = (
    "美联储", "摩根大通", "特朗普", "拜登", "伊朗", "以色列", "欧盟", "欧佩克", "OPEC", "WTI", "布伦特", "原油", "黄金", "地缘", "关税", "非农", "CPI", "PPI", "俄乌", "中东", "朝鲜", "日本央行",
    "英国央行", "美债", "美元指数", "加拿大",
)
EXTRA_EVENT_GROUPS = (
    ("注资", ("注资", "增资", "特别国债")),
)
CORE_FACTS = (
    ("security_warning", ("安全警示", "安全警报", "安全警告", "安全提醒")),
    ("mass_production", ("正式量产", "实现量产", "投入量产", "量产")),
    ("capacity_expansion", ("产能扩张", "扩充产能", "新增产能", "产能翻倍", "扩产")),
    ("buyback_completion", ("回购完成", "完成回购", "回购注销", "注销回购股份")),
    ("regulatory_filing", ("立案调查", "被立案", "立案")),
    ("delisting", ("退市", "终止上市")),
    ("strike", ("罢工", "大罢工")),
    ("shutdown", ("停产", "停工")),
)
TITLE_UP_WORDS = (
    "涨", "升", "利好", "增持", "预增", "突破", "涨停", "上涨", "飙升", "反弹", "回升", "创新高",
)
TITLE_DOWN_WORDS = (
    "跌", "降", "利空", "减持", "预减", "跌停", "下跌", "暴跌", "走低", "重挫", "回落", "跳水",
)
SESSIONS = {
    "open": ("开盘", "早盘", "盘前"), "noon": ("午评", "午盘"), "close": ("收盘", "尾盘", "盘后"),
}
MARKET_DOMAINS = {
    "us": ("美股", "道指", "纳指", "标普", "谷歌", "苹果", "特斯拉", "英伟达"), "a": ("A股", "沪指", "深成指", "创业板", "科创50", "沪深"), "kr": ("韩股", "韩国综指", "科斯达克"),
    "jp": ("日经", "日股"), "hk": ("恒指", "港股"), "eu": ("欧股", "欧洲股市"),
}
INDEX_NAMES = (
    "纳指", "道指", "标普", "恒指", "日经", "韩指", "韩国综指", "科斯达克", "沪指", "深成指", "创业板指", "科创50", "上证", "沪深300", "富时100",
)
COLUMN_MARKERS = (
    "新闻精选", "晚间新闻", "要闻速递", "隔夜要闻", "全球要闻", "九点特供", "风口研报", "投资避雷针", "午评", "收评", "盘前速递", "新闻速览", "涨停分析", "盘前要闻", "市场要闻", "研报精选", "新闻汇总", "要闻汇总",
    "市场汇总", "期货热点追踪", "局势跟踪", "主力资金流向", "资金流向",
)
DAILY_COLUMNS = (
    "局势跟踪", "期货热点追踪", "盘前要闻一览", "要闻速递", "新闻汇总", "要闻汇总", "市场汇总", "资金流向日报", "主力资金监控", "投资避雷针", "行业动态汇总", "每日动态汇总", "早间要闻", "隔夜要闻",
)
EVENT_VERBS = (
    "公告", "订单", "中标", "签约", "签署", "收购", "并购", "增持", "回购", "业绩", "净利", "营收", "投产", "扩产", "产能", "涨价", "提价", "定增", "分红", "获批", "量产", "交付", "出货", "制裁",
    "管制", "关税", "降准", "降息", "加息", "立案", "问询", "减持", "融资", "合作", "大单", "解禁", "停牌", "复牌", "调查", "处罚", "价格", "报价", "售价", "缺货", "供不应求", "库存",
)
INDEX_MOVES = (
    "涨超", "跌超", "涨逾", "跌逾", "涨幅扩大", "跌幅扩大", "涨幅扩大至", "跌幅扩大至", "现报", "开涨", "开跌", "收涨", "收跌", "上涨", "下跌", "半日跌", "半日涨", "盘中跌", "盘中涨", "日内跌", "日内涨",
    "涨幅超过", "跌幅超过", "涨幅超", "跌幅超", "创新高", "创新低", "短线走高", "短线走低",
)
INTRADAY_WORDS = (
    "异动拉升", "直线涨停", "直线跌停", "盘初走强", "盘中走强", "短线走高", "震荡拉升", "尾盘拉升", "午后拉升", "冲高回落", "快速走强", "集体走强", "表现活跃", "概念活跃", "持续活跃", "反复活跃", "概念走强", "概念走高",
    "集体大涨", "涨停潮", "活跃拉升", "震荡回升", "震荡回落", "震荡走高", "震荡走低", "净流入", "净流出", "中单净流出", "资金出逃", "快速跳水", "大幅跳水", "跳水", "异动", "涨停", "跌停", "集体高开", "集体低开",
    "延续强势", "持续下挫", "持续走强", "连板",
)
CORPORATE_EVENTS = (
    "立案", "留置", "退市", "欺诈", "被罚", "刑拘", "逮捕", "冻结", "破产", "暴雷", "爆雷", "双双被", "被查", "回应", "公告", "澄清", "减持", "回购", "增持", "处罚", "问询", "批复", "核准",
)
OVERSEAS_STOCKS = (
    "SK海力士", "三星电子", "台积电", "美光", "铠侠", "英伟达", "AMD", "英特尔",
)
OVERSEAS_MOVES = (
    "涨超", "跌超", "涨逾", "跌逾", "涨幅扩大", "跌幅扩大", "涨幅扩大至", "跌幅扩大至", "现报", "开涨", "开跌", "收涨", "收跌", "涨幅超过", "跌幅超过", "涨幅超", "跌幅超", "创新高", "创新低", "盘中涨", "盘中跌",
)
EVENT_PHRASES = (
    "合资", "收购", "并购", "建厂", "成立", "融资", "回购", "入股", "签约", "中标", "停牌", "重组", "破产", "退市", "处罚", "立案", "增持", "减持", "注资", "增资",
)
MACRO_EVENT_WORDS = (
    "CPI", "PPI", "通胀", "物价", "非农", "失业率", "GDP", "利率决议", "FOMC", "就业数据",
)
MARKET_STATES = (
    "行情下跌", "行情上涨", "行情震荡",
)
CENTRAL_BANKS = (
    "日本央行", "美联储", "欧央行", "中国人民银行", "英国央行", "韩国央行", "澳洲联储", "瑞士央行", "加拿大央行",
)
HAWK_WORDS = (
    "加息", "升息", "缩表", "紧缩", "收紧",
)
DOVE_WORDS = (
    "降息", "扩表", "宽松", "降准", "量化宽松", "放水",
)
POLICY_EVENT_WORDS = (
    "加息", "降息", "缩表", "扩表", "宽松", "紧缩", "升息", "降准", "量化宽松", "YCC", "收益率曲线控制",
)
MARKET_MOVES = (
    "普涨", "普跌", "高开", "低开", "走强", "走弱", "上涨", "下跌", "涨超", "跌超", "升逾", "涨逾", "跳水", "回升", "大涨", "大跌", "拉升", "上扬", "下挫", "冲高", "回落", "涨近", "跌近", "涨幅扩大",
    "跌幅扩大",
)
MACRO_POLICY_WORDS = (
    "央行", "证监会", "国常会", "政治局", "国务院", "降准", "降息", "加息", "CPI", "PPI", "通胀", "物价", "利率决议", "FOMC", "GDP", "失业率", "就业数据", "非农", "美债", "社融", "LPR",
    "PMI", "印花税", "注册制", "平准基金", "汇金", "国家队", "美联储", "鲍威尔", "欧央行", "地缘", "战争", "关税", "贸易战", "制裁", "出口管制", "中东", "台海", "原油暴跌", "原油暴涨",
)
MARKET_THEMES = (
    ("美加关税", ("加拿大", "关税", "卢特尼克", "美加")),
    ("伊朗制裁", ("伊朗", "里亚尔", "霍尔木兹")),
    ("日本央行", ("日本央行", "日元", "植田")),
    ("美债/美财长", ("美债", "贝森特")),
    ("俄乌冲突", ("俄乌", "乌克兰", "克里姆林宫")),
    ("中东局势/油价", ("中东", "以色列", "黎巴嫩", "油价", "原油", "柴油期货", "柴油价格")),
)
HARD_EVENTS = (
    ("mass_production", ("量产", "投产", "复产")),
    ("price_change", ("涨价", "提价", "降价")),
    ("capacity_expansion", ("扩产", "扩建", "产能扩张", "新增产能", "产能翻倍", "产能提升", "产能释放")),
    ("buyback_completion", ("回购完成", "完成回购", "回购注销", "注销回购股份")),
    ("regulatory_action", ("立案", "立案调查", "行政处罚", "监管处罚")),
    ("delisting", ("退市", "终止上市")),
    ("labor_or_shutdown", ("罢工", "停产", "停工")),
    ("deal_completion", ("收购完成", "完成收购", "并购完成", "重组完成", "重大中标", "中标", "重大合同", "签约")),
)
CAPACITY_WORDS = (
    "翻倍", "倍增", "增长", "提升", "扩张", "释放", "扩产",
)
INCREMENT_WORDS = (
    "较", "增至", "涨至", "跌至", "降至", "回落至", "增长", "增逾", "增", "落地", "获批", "核准", "中标", "签署", "达成", "上调", "下调", "增持", "减持", "回购", "解除质押", "质押", "扩产", "投产",
    "交付", "创新高", "创下", "突破", "立案", "调查", "回购",
)
EMOTION_WORDS = (
    "疯涨", "疯抢", "炸裂", "惊呆", "震惊", "崩了", "疯了", "太猛", "杀疯了", "史诗级", "王炸", "炸锅", "嗨了", "慌了", "火了", "爆了", "彻底慌", "要变天", "大事不好", "紧急提醒", "速看", "刚刚传来",
)
TRUNCATED_ENDINGS = (
    "…", "。。。", "...", "。。",
)
MACRO_DATA_PATTERNS = (
    "(?<![A-Za-z0-9])CPI(?![A-Za-z0-9])", "(?<![A-Za-z0-9])PPI(?![A-Za-z0-9])", "(?<![A-Za-z0-9])FOMC(?![A-Za-z0-9])",
    "(?<![A-Za-z0-9])GDP(?![A-Za-z0-9])", "(?<![A-Za-z0-9])PMI(?![A-Za-z0-9])", "(?<![A-Za-z0-9])LPR(?![A-Za-z0-9])", "非农", "失业率", "通胀", "物价",
    "利率决议", "美债", "社融", "贸易帐", "消费者物价", "生产者物价", "出厂价格", "居民消费价格", "工业生产者", "财政收入",
)
RELEASE_CONTEXT = (
    "公布", "发布", "数据", "预期", "前值", "年率", "月率", "录得", "符合预期", "同比", "环比", "符合市场预期",
)
DEAL_WORDS = (
    "中标", "签约", "签订", "签署", "斩获", "拿下", "大额订单", "重大合同", "重大工程", "建厂", "投建", "投产", "扩产", "扩建", "重启", "量产", "增资", "落地",
)
ENTITY_ALIASES = {
    "大摩": "摩根士丹利", "小摩": "摩根大通", "TSMC": "台积电", "三星电子": "三星", "Samsung": "三星", "海力士": "SK海力士", "SK Hynix": "SK海力士", "NVIDIA": "英伟达", "Tesla": "特斯拉",
    "Apple": "苹果", "Google": "谷歌", "Alphabet": "谷歌", "Microsoft": "微软", "Amazon": "亚马逊", "欧洲央行": "欧央行", "ECB": "欧央行", "日央行": "日本央行", "BOJ": "日本央行",
    "Fed": "美联储", "长鑫存储": "长鑫科技", "CXMT": "长鑫科技", "上海市": "上海", "北京市": "北京",
}
CHAIN_WORDS = (
    "CPO", "光模块", "光通信", "光芯片", "PCB", "覆铜板", "铜箔", "玻纤", "电子布", "存储", "HBM", "DRAM", "NAND", "MLCC", "算力", "数据中心", "液冷", "AI芯片",
)
NOISE_LEADERS = (
    "中际旭创", "寒武纪", "宁德时代", "新易盛", "天孚通信", "源杰科技", "生益科技", "南亚新材", "鼎泰高科", "中国巨石", "风华高科", "英伟达", "台积电", "三星电子", "SK海力士", "美光", "阿斯麦", "ASML", "长江存储",
    "长鑫存储",
)
VIEW_WORDS = (
    "机构称", "机构认为", "研报", "点评", "观点", "看好", "展望", "解读", "市场空间", "有望", "传导", "开启", "浪潮", "风口", "逻辑", "下注方向", "警告", "示警", "预计", "目标价", "评级", "加码",
)
HEADLINE_ENTITIES = (
    "DeepSeek", "寒武纪", "中际旭创", "长江存储", "长鑫存储", "华为", "海思", "腾讯", "阿里", "阿里巴巴", "字节", "百度", "小米", "比亚迪", "宁德时代", "英伟达", "台积电", "三星", "SK海力士", "海力士",
    "美光", "铠侠", "ASML", "OpenAI", "Anthropic", "微软", "谷歌", "苹果", "特斯拉", "Meta", "亚马逊", "钙钛矿", "固态电池",
)
DONE_EVENT_WORDS = (
    "中标", "签约", "签署", "获批", "收购", "并购", "入股", "回购", "增持", "量产", "扩产", "扩建", "投产", "建成", "投运", "上线", "发布", "拿下", "交付", "落户", "良率", "产能", "出货",
)
FORWARD_WORDS = (
    "有望", "预期", "预计", "或", "计划", "拟", "验证", "窗口", "开启", "迎",
)
ANNOUNCEMENT_TYPES = (
    ("解除质押", ("解除质押", "解押")),
    ("质押", ("质押",)),
    ("回购", ("回购",)),
    ("增持", ("增持",)),
    ("减持", ("减持",)),
    ("业绩预告", ("业绩预告",)),
    ("业绩快报", ("业绩快报",)),
    ("重大合同", ("重大合同", "中标")),
    ("分红送转", ("分红", "派息", "送转", "利润分配")),
    ("立案处罚", ("立案", "处罚", "监管函", "问询函", "关注函")),
)
SECTOR_RULES = (
    ("存储芯片", ("存储芯片", "半导体/存储芯片", "hbm", "dram", "nand", "闪存", "存储器")),
    ("光模块", ("光模块", "cpo", "光通信")),
    ("AI算力", ("ai算力", "ai/算力", "ai芯片", "ai硬件", "算力", "云计算", "服务器", "数据中心", "idc")),
    ("半导体", ("半导体", "晶圆", "国产替代", "芯片", "封测", "光刻", "设备")),
    ("能源", ("能源", "原油", "石油", "油气", "石化", "煤炭", "天然气")),
    ("宏观", ("宏观", "利率", "汇率", "美联储", "央行", "cpi", "pmi")),
    ("电子元件", ("mlcc", "电子元件", "被动元件", "电容")),
    ("港股", ("中概股", "港股")),
    ("化工", ("化工", "化学")),
    ("制造业", ("制造业", "工业")),
)
BEARISH_TEXT = (
    "利空", "暴跌", "下跌", "亏损", "减持", "处罚", "立案", "退市", "爆雷", "违约", "承压", "下滑", "萎缩", "受挫", "受阻", "负面", "恶化", "巨亏", "重挫", "闪崩", "崩盘", "跌停", "大亏", "熔断",
    "跌至", "走低", "下挫", "恐慌", "抛售", "逊于预期", "低于预期", "不及预期", "创新低", "回调", "搁浅", "叫停", "风险警示", "制裁", "管制", "禁运", "关税",
)
BULLISH_TEXT = (
    "利好", "暴涨", "上涨", "盈利", "增持", "回购", "补贴", "扶持", "突破", "超预期", "预增", "增长", "提振", "刺激", "宽松", "涨停", "大涨", "走强", "回暖", "走高", "净流入", "流入", "创新高",
    "涨超", "扭亏", "中标", "签约", "扩产", "满产", "订单饱满",
)
RISK_WORDS = (
    "战争", "导弹", "空袭", "军事行动", "军事打击", "军事警告", "制裁升级", "地缘紧张", "地缘风险", "局势紧张", "局势动荡", "战争阴云", "交火", "武装冲突", "边境冲突", "risk-off", "避险情绪", "军事演习",
    "军事部署", "战云", "紧张局势", "地缘局势", "冲突升级",
)
BENEFIT_WORDS = (
    "涨", "利好", "订单", "中标", "突破", "创新高", "大涨", "上涨", "净流入", "扩产", "签约", "受益", "提振", "飙升", "走高", "拉升",
)
NEUTRAL_PHRASES = (
    "无明确多空信号", "无实质影响", "无重大影响", "无明显影响", "无实际影响", "无明确方向", "无重大变动", "无重大变化", "影响中性", "常规披露", "例行披露", "常规事项", "无具体影响", "中性看待",
)
CORE_TRANSMISSION = (
    "制裁", "出口管制", "禁运", "实体清单", "关税", "贸易战", "美联储", "加息", "降息", "缩表", "QE", "鲍威尔", "非农", "CPI", "PPI", "熔断", "崩盘", "债务危机", "银行危机", "金融风险", "系统性风险",
    "战争", "军事冲突", "冲突", "地缘", "俄乌", "中东", "台海", "降准", "印花税", "注册制", "北向资金", "A股", "沪指", "深证", "创业板", "沪深300", "大盘", "纳指", "纳斯达克", "美股", "恒生科技",
    "费城半导体",
)
TECH_SECTOR_TERMS = (
    "新能源", "光伏", "储能", "人工智能", "AI", "大模型", "算力", "数据要素", "消费电子", "汽车电子", "锂电", "氢能", "机器人", "电子", "通信", "软件", "计算机", "信息技术", "数字经济", "智能制造", "自动化",
    "量子", "元宇宙",
)
FORECAST_DIRECTIONS = {
    "预增": "bullish", "略增": "bullish", "扭亏": "bullish", "续盈": "bullish", "预减": "bearish", "略减": "bearish", "首亏": "bearish", "增亏": "bearish",
    "续亏": "bearish", "减亏": "bullish", "不确定": "neutral",
}
ROUTINE_TITLES = (
    "翌日披露报表", "月报表", "会议资料", "投资者关系管理信息", "投资者关系活动记录",
)
TOPIC_WORDS = (
    "optical", "transceiver", "co-packaged", "cpo", "data center", "datacenter", "nvidia", "ai chip", "semiconductor", "chip", "pcb", "copper clad",
    "laminat", "hbm", "800g", "1.6t", "silicon photonic", "innolight", "eoptolink",
)

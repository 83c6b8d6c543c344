"""Lexicons and lists with fixed values: labels with the patterns that name them, hosts by tier, stop words.

Patterns are written with an ASCII word boundary; functions.text.pattern() gives them the form that Spark matches alike.
"""

#: Entities in order of precedence.
ENTITIES = [
    ("openai", r"\bopenai\b"),
    ("nvidia", r"\bnvidia\b|英伟达"),
    ("google", r"\bgoogle\b|谷歌"),
    ("anthropic", r"\banthropic\b"),
    ("microsoft", r"\bmicrosoft\b|微软"),
    ("meta", r"\bmeta\b|元宇宙平台"),
    ("apple", r"\bapple\b|苹果公司"),
    ("amazon", r"\bamazon\b|亚马逊"),
    ("amd", r"\bamd\b"),
    ("intel", r"\bintel\b|英特尔"),
    ("tsmc", r"\btsmc\b|台积电"),
    ("federal-reserve", r"\bfederal reserve\b|\bthe fed\b|美联储"),
    ("sec", r"\bu\.?s\.? sec\b|\bSEC\b|\bsecurities and exchange commission\b|美国(?:证监会|证交会)"),
    ("united-nations", r"\bunited nations\b|\bun\b|联合国"),
    ("china", r"\bchina\b|中国"),
    ("united-states", r"\bunited states\b|\bu\.?s\.?\b|美国"),
    ("european-union", r"\beuropean union\b|\beu\b|欧盟"),
    ("oecd", r"\boecd\b|经济合作与发展组织"),
    ("unesco", r"\bunesco\b|联合国教科文组织"),
    ("international-baccalaureate", r"\binternational baccalaureate\b|\bIB\b|国际文凭"),
    ("world-bank", r"\bworld bank\b|世界银行"),
    ("imf", r"\bIMF\b|international monetary fund|国际货币基金组织"),
    ("sk-hynix", r"\bsk\s+hynix\b|sk海力士"),
    ("berkshire-hathaway", r"\bberkshire(?:\s+hathaway)?\b|伯克希尔"),
    ("alphabet", r"\balphabet\b"),
    ("bls", r"\bbureau of labor statistics\b|\bbls\b|美国劳工统计局"),
    ("grok", r"\bgrok\b"),
    ("mit-sloan", r"\bmit\s+sloan\b|MIT斯隆"),
    ("israel", r"\bisrael(?:i)?\b|以色列"),
    ("iran", r"\biran(?:ian)?\b|伊朗"),
    ("oman", r"\boman\b|阿曼"),
    ("indonesia", r"\bindonesia(?:n)?\b|印度尼西亚|印尼"),
    ("japan", r"\bjapan(?:ese)?\b|日本"),
    ("south-korea", r"\bsouth korea(?:n)?\b|韩国"),
    ("north-korea", r"\bnorth korea(?:n)?\b|朝鲜"),
    ("uae", r"\bUAE\b|united arab emirates|阿联酋"),
    ("russia", r"\brussia(?:n)?\b|俄罗斯|俄军"),
    ("ukraine", r"\bukrain(?:e|ian)\b|乌克兰|乌军"),
    ("france", r"\bfrance\b|\bfrench\b|法国"),
    ("groq", r"\bgroq\b"),
    ("hugging-face", r"\bhugging\s*face\b|huggingface"),
    ("research-team", r"research team|研究团队"),
    ("education-department", r"department of education|education department|教育部门|教育主管部门"),
    ("hackers", r"\bhackers?\b|黑客"),
    ("taliban", r"\btaliban\b|塔利班"),
    ("strait-of-hormuz", r"\bstrait of hormuz\b|霍尔木兹海峡"),
    ("school", r"\bschool\b|学校"),
    ("students", r"\bstudents?\b|\bkids\b|\bpupils?\b|学生|儿童"),
    ("us-universities", r"\b(?:u\.?s\.?|american) universities\b|美国大学"),
    ("university", r"\buniversity\b|大学"),
]

#: Actions in order of precedence.
ACTIONS = [
    ("launch", r"\blaunch(?:es|ed|ing)?\b|\breleas(?:e|es|ed|ing)\b|\bunveil(?:s|ed|ing)?\b|\bintroduc(?:e|es|ed|ing)\b|\bannounc(?:e|es|ed|ing)\b|发布|推出|亮相|上线|公布|宣布"),
    ("acquire", r"\bacquir(?:e|es|ed|ing)\b|\bmerg(?:e|es|ed|ing)\b|\bbuy(?:s|ing)?\b|收购|并购|合并"),
    ("funding", r"\bfund(?:ing|ed)?\b|\bfinanc(?:e|es|ed|ing)\b|\bfinancing\b|\brais(?:e|es|ed|ing)\b|\binvest(?:s|ed|ing|ment)\b|融资|募资|投资"),
    ("earnings", r"\bearnings?\b|\brevenue\b|\bprofit\b|\bguidance\b|财报|营收|利润|业绩|指引"),
    ("appoint", r"\bappoint(?:s|ed|ing)?\b|\bresign(?:s|ed|ing)?\b|\bsteps? down\b|任命|辞职|离任"),
    ("investigate", r"\binvestigat(?:e|es|ed|ing|ion)\b|\blawsuit\b|\bsues?\b|\bprobe\b|调查|起诉|诉讼|审查"),
    ("security", r"\bhack(?:s|ed|ing|ers?)?\b|\bbreach\b|\bcyberattack\b|\bvulnerability\b|\btheft\b.{0,32}\bdata\b|黑客|泄露|窃取|网络攻击|漏洞"),
    ("rates", r"\brate (?:cut|hike)\b|\bcuts? rates?\b|\braises? rates?\b|降息|加息|利率决定"),
    ("agreement", r"\bagreement\b|\bdeal\b|\bpartner(?:s|ed|ing|ship)?\b|\bceasefire\b|协议|合作|联合|停火"),
    ("restriction", r"\bban(?:s|ned|ning)?\b|\bsanction(?:s|ed)?\b|\bexport control\b|禁令|制裁|出口管制"),
    ("attack", r"\battack(?:s|ed|ing)?\b|\bstrike(?:s)?\b|\binvad(?:e|es|ed|ing)\b|袭击|空袭|入侵"),
    ("policy", r"\bregulat(?:e|es|ed|ing|ion)\b|\bpolicy\b|\brule\b|监管|政策|新规"),
    ("build", r"\bbuild(?:s|ing)?\b|\bopen(?:s|ed|ing)?\b|\bexpan(?:d(?:s|ed|ing)?|sion)\b|建设|开设|设立|建立|扩建|扩张"),
    ("stake-change", r"\badds?\b.{0,36}\bstake\b|\bincreases?\b.{0,24}\bstake\b|增持|减持"),
    ("reduce", r"\bcuts?\b|\breduc(?:e|es|ed|ing)\b|\blower(?:s|ed|ing)?\b|下调|削减|降低"),
    ("support", r"\bsupport(?:s|ed|ing)?\b|\bhelp(?:s|ed|ing)?\b|支持|帮助"),
    ("negotiate", r"\bnegotiat(?:e|es|ed|ing|ion|ions)\b|\btalks?\b|谈判|会谈|和谈"),
    ("death", r"\bfound dead\b|\bdies?\b|\bdeath\b|去世|死亡|身亡"),
    ("rank-change", r"\brankings?\b|\brises?\b|\badvances?\b|排名|上升|前进"),
    ("misuse", r"\bmisus(?:e|es|ed|ing)\b|\btransform(?:s|ed|ing)?\b.{0,48}\bexplicit\b|滥用|露骨图像"),
    ("explain", r"\bdetails?\b|\bexplain(?:s|ed|ing)?\b|说明|介绍|详解"),
    ("rescue", r"\brescu(?:e|es|ed|ing)\b|\bsearch(?:es|ed|ing)? for survivors\b|救援|搜寻幸存者"),
    ("implement", r"\bimplement(?:s|ed|ing|ation)?\b|\brolls? out\b|实施|推进|启动"),
    ("fraud-charge", r"\bcharges?\b.{0,80}\bfraud|\bdefraud(?:s|ed|ing)?\b|指控.{0,40}欺诈|诈骗"),
    ("sentence", r"\bsentenced\b|\bsentencing\b|\b(?:court|judge)\b.{0,36}\bsentences?\b|\bjailed?\b|\bimprison(?:s|ed|ment)?\b|\bprison term\b|被判刑|判处|获刑|监禁|入狱"),
    ("maintain", r"\bmaintain(?:s|ed|ing)?\b|\bholds?\b.{0,24}\b(?:rates?|steady)\b|\bkeeps?\b.{0,24}\brates?\b|维持|保持(?:不变|稳定)"),
    ("update", r"\bupdat(?:e|es|ed|ing)\b|更新|修订"),
    ("research-find", r"\b(?:research|study|experiment)\b.{0,80}\b(?:finds?|found|shows?|showed|suggests?|suggested|demonstrates?|demonstrated)\b|\b(?:finds?|found|shows?|showed|suggests?|suggested)\b.{0,80}\b(?:learning|students?|pupils?|kids)\b|\b(?:may|can|could)\s+learn more\b|\blearn(?:ed|s)? more\b|研究(?:团队)?(?:发现|表明|显示)|实验(?:发现|表明|显示)|结果(?:显示|表明)"),
    ("adopt", r"\badopt(?:s|ed|ing|ion)?\b|\bdeploy(?:s|ed|ing|ment)?\b|\bintegrat(?:e|es|ed|ing|ion)\b|\buses?\b.{0,36}\b(?:AI|artificial intelligence)\b|采用|引入|部署|整合"),
    ("join", r"\bjoin(?:s|ed|ing)?\b|\benters?\b.{0,24}\b(?:program|programme|initiative)\b|加入|参与.{0,16}(?:计划|项目)"),
    ("decline", r"\b(?:declin(?:e|es|ed|ing)|slid(?:e|es|ing)|fall(?:s|ing)?|fell|drop(?:s|ped|ping))\b|下滑|衰退|下降|跌落"),
    ("enforce", r"\benforcement action\b|\benforc(?:e|es|ed|ing|ement)\b|执法行动|采取执法|执行监管"),
    ("strengthen", r"\b(?:strengthen|tighten)(?:s|ed|ing)?\b|强化|加强|收紧|增强"),
    ("threaten", r"\bthreaten(?:s|ed|ing)?\b|威胁|恐吓"),
    ("warn", r"\bwarn(?:s|ed|ing)?\b|警告|警示"),
    ("reach", r"\b(?:reach|contact)(?:es|ed|ing)?\b|接触|抵达|恢复联系"),
]

#: Objects in order of precedence.
OBJECTS = [
    ("cpi", r"\bcpi\b|consumer price index|消费者价格指数|居民消费价格"),
    ("ppi", r"\bppi\b|producer price index|生产者价格指数|工业生产者价格"),
    ("pce", r"\bpce\b|personal consumption expenditures|个人消费支出"),
    ("interest-rate", r"interest rates?|rate cut|rate hike|policy rate|利率|降息|加息"),
    ("bond-yield", r"treasury yields?|bond yields?|国债收益率|债券收益率"),
    ("earnings-results", r"earnings|quarterly results|financial results|revenue|profit|guidance|财报|季报|营收|利润|业绩|指引"),
    ("product-release", r"\b(?:products?|platforms?|models?|chips?|gpus?|processors?|software|apps?)\b|产品|平台|模型|芯片|处理器|软件|应用"),
    ("acquisition-target", r"acquisition|acquire|merger|收购|并购|合并"),
    ("funding-round", r"funding round|financing|investment|raise[ds]?|融资|募资|投资"),
    ("factory-capacity", r"factory|fab|capacity|production line|产能|工厂|晶圆厂|生产线"),
    ("data-center", r"data cent(?:er|re)|ai factory|算力中心|数据中心"),
    ("ai-center", r"ai (?:technology )?cent(?:er|re)|AI中心|人工智能中心"),
    ("course-curriculum", r"course|curriculum|syllabus|课程|课程改革|教学大纲"),
    ("assessment", r"assessment|test standards?|exam|pisa|评估|测评|考试"),
    ("ai-literacy", r"ai literacy|artificial intelligence literacy|人工智能素养|ai 素养"),
    ("education-policy", r"education policy|school policy|education reform|教育政策|教育改革"),
    ("sanctions-controls", r"sanctions?|export controls?|制裁|出口管制"),
    ("military-strike", r"\battacks?\b|airstrikes?|missile|drone attack|袭击|空袭|导弹|无人机"),
    ("ceasefire-talks", r"ceasefire|peace talks?|negotiations?|停火|和谈|谈判"),
    ("shipping-route", r"shipping|vessels?|strait|canal|航运|船只|海峡|运河"),
    ("oil-price", r"oil prices?|brent|wti|原油|油价|布兰特"),
    ("earthquake", r"earthquake|magnitude|地震|震级"),
    ("memory-capacity", r"\b(?:hbm|ai)\s+memory\b|memory capacity|内存产能|存储产能|HBM"),
    ("equity-stake", r"\b(?:equity|shareholding|stake)\b|股份|持股"),
    ("ev-target", r"electric vehicle sales targets?|\bEV\b.{0,20}targets?|电动车销售目标"),
    ("fraud-case", r"fraud|scam|boiler room|欺诈|骗局|诈骗"),
    ("university-ranking", r"university rankings?|shanghai rankings?|大学排名"),
    ("image-abuse", r"explicit imagery|explicit image|childhood photo|露骨图像|儿童照片|童年照片"),
    ("watermark", r"watermarks?|水印"),
    ("coding-agent", r"coding agent|code agent|software development agent|编程智能体|代码智能体"),
    ("student-support", r"student parents?|caregivers?|childcare|学生父母|学生家长|托儿"),
    ("mba-program", r"evening mba|mba program|晚间MBA|MBA课程"),
    ("creative-program", r"digital creativity lab|digital arts|数字创意实验室|数字艺术"),
    ("executive-governance", r"executive departures?|talent exodus|ipo governance|高管离职|上市治理"),
    ("vaccine-health", r"vaccines?|autism|covid-?19|疫苗|自闭症|新冠"),
    ("security-agreement", r"security agreement|defen[cs]e agreement|安全协议|防务合作"),
    ("criminal-sentence", r"\bsentenced\b|\bsentencing\b|\b(?:court|judge)\b.{0,36}\bsentences?\b|jailed?|imprison(?:ed|ment)?|prison term|判刑|获刑|监禁"),
    ("learning-science", r"learning science|learning experiment|学习科学|学习实验"),
    ("teacher-training", r"teacher training|faculty training|教师培训|师资培训"),
    ("education-report", r"education trends? report|education report|教育趋势报告|教育报告"),
    ("learning-method", r"mastery learning|review mistakes?|error review|learning outcomes?|math learning|学习方法|复盘错误|错题复习|学习成效"),
    ("higher-education-trend", r"universit(?:y|ies).{0,48}(?:declin|slid|fall|ranking|competit)|higher education.{0,48}(?:declin|trend|competit)|大学.{0,24}(?:下滑|衰退|排名|竞争力)|高等教育趋势"),
    ("ai-teaching", r"(?:school|classroom|teaching|students?).{0,48}(?:\bAI\b|artificial intelligence)|(?:\bAI\b|人工智能).{0,48}(?:学校|课堂|教学|学生)|AI教学"),
    ("research-program", r"research program(?:me)?|horizon europe|research initiative|科研计划|研究项目|科研项目"),
    ("financial-regulation", r"federal reserve|securities and exchange commission|\bSEC\b|enforcement action|financial regulation|美联储|证交会|金融监管"),
    ("student-data", r"student data|student information|education ministry info|学生数据|学生信息|教育部门数据"),
    ("ai-governance", r"democratic oversight|national security oversight|ai governance|人工智能治理|国家安全治理|民主监督"),
    ("ai-training", r"prepare.{0,36}ai generation|ai generation.{0,36}(?:skills?|training|prepare)|ai workforce|ai talent|AI人才|人工智能人才|AI培训"),
    ("identity-exposure", r"identity.{0,24}(?:leak|reveal|expos)|(?:leak|breach).{0,24}(?:identity|identities)|(?:data|information).{0,24}leak|身份.{0,12}(?:泄露|曝光)|数据泄露"),
    ("threatened-person", r"former Afghan police worker|Afghan former police|前阿富汗警员"),
    ("model-report", r"state of open models|open models?.{0,24}(?:report|observations?)|开源模型.{0,16}(?:报告|观察)"),
    ("humanitarian-access", r"humanitarian (?:access|workers?|aid)|famil(?:y|ies).{0,24}(?:besieg|trapp|surround)|人道工作者|人道援助|受困家庭|被围困.{0,12}家庭"),
    ("ai-policy-proposal", r"policy ideas?|policy proposals?|(?:AI|artificial intelligence).{0,32}(?:policy|policies).{0,32}students?|students?.{0,32}(?:AI|artificial intelligence).{0,32}(?:policy|policies)|政策建议|政策主张|学生.{0,16}AI教育政策"),
    ("agent-data-workflow", r"strands agents?|lerobot|storage buckets?|record,?\s*train,?\s*and deploy|智能体训练部署流程"),
    ("executive-appointment", r"chief revenue officer|\bCRO\b|首席营收官"),
]

#: Locations in order of precedence.
LOCATIONS = [
    ("china", r"\bchina\b|中国"),
    ("united-states", r"\bunited states\b|\bU\.?S\.?\b|美国"),
    ("europe", r"\beurope\b|欧洲"),
    ("middle-east", r"\bmiddle east\b|中东"),
    ("indonesia", r"\bindonesia\b|印度尼西亚|印尼"),
    ("south-korea", r"\bsouth korea\b|韩国"),
    ("north-korea", r"\bnorth korea\b|朝鲜"),
    ("israel", r"\bisrael\b|以色列"),
    ("lebanon", r"\blebanon\b|黎巴嫩"),
    ("iran", r"\biran\b|伊朗"),
    ("oman", r"\boman\b|阿曼"),
    ("pakistan", r"\bpakistan\b|巴基斯坦"),
    ("united-kingdom", r"\bunited kingdom\b|\bUK\b|英国"),
    ("black-sea", r"\bblack sea\b|黑海"),
    ("strait-of-hormuz", r"\bstrait of hormuz\b|霍尔木兹海峡"),
    ("egypt", r"\begypt\b|埃及"),
    ("uae", r"\bUAE\b|united arab emirates|阿联酋"),
    ("russia", r"\brussia\b|俄罗斯"),
    ("ukraine", r"\bukraine\b|乌克兰"),
    ("armenia", r"\barmenia\b|亚美尼亚"),
]

#: Objects that are economic indicators.
INDICATORS = ["cpi", "ppi", "pce", "interest-rate", "bond-yield", "earnings-results", "oil-price"]

#: Words that carry no meaning of their own in comparisons.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is",
    "it", "new", "of", "on", "or", "says", "that", "the", "to", "with", "after", "amid",
    "about", "into", "its", "their", "this", "will", "ai", "news", "report", "reports", "update", "latest",
    "major", "today", "company", "market", "industry", "archive", "archives", "index", "category", "categories", "tag", "tags",
    "page", "homepage",
]

#: Fixed value: wording of rumours.
RUMOR = r"\brumou?r(?:s|ed)?\b|\breportedly\b|\bsources? (?:say|said)\b|\bpeople familiar with\b|消息人士|知情人士|传闻|据悉|或将|据称"

#: Hosts of this tier.
OFFICIAL_HOSTS = [
    "openai.com", "anthropic.com", "nvidia.com", "amd.com", "intel.com", "tsmc.com",
    "microsoft.com", "google.com", "federalreserve.gov", "bls.gov", "bea.gov", "sec.gov",
    "eia.gov", "treasury.gov", "whitehouse.gov", "investor.gov", "un.org", "nato.int",
    "consilium.europa.eu", "ec.europa.eu", "ibo.org", "oecd.org", "unesco.org", "worldbank.org",
    "imf.org",
]

#: Hosts of this tier.
TIER_ONE_HOSTS = [
    "reuters.com", "apnews.com", "bbc.com", "bbc.co.uk", "bloomberg.com", "ft.com",
    "wsj.com", "cnbc.com", "npr.org", "theguardian.com", "dw.com", "aljazeera.com",
    "lemonde.fr",
]

#: Hosts of this tier.
TIER_TWO_HOSTS = [
    "techcrunch.com", "semiengineering.com", "edsurge.com", "hechingerreport.org", "insidehighered.com", "educationnext.org",
    "edscoop.com", "technologyreview.com",
]

"""Word lists, code maps, patterns and limits that results depend on.

They are data. Every operator takes them as parameters, so another corpus brings its own.
"""

# --- Fixed values: label scheme -------------------------------------------------------
CATEGORY_WORKS = 7
CATEGORY_GENERAL = 8
CATEGORY_ENGINEERING = 9
CATEGORIES_IN_SCOPE = (7, 8, 9)
LABEL_BY_CATEGORY = {7: "obras", 8: "geral", 9: "engenharia"}
SUBCLASS_BY_CATEGORY = {7: "obra", 8: "serv_geral", 9: "serv_engenharia"}
POSITIVE_LABELS = ("engenharia", "obras")
UNLABELLED = "geral"

# --- Fixed values: code maps ----------------------------------------------------------
CATEGORY_NAMES = {
    1: "Cessão", 2: "Compras", 3: "Informática (TIC)", 4: "Internacional",
    5: "Locação Imóveis", 6: "Mão de Obra", 7: "Obras", 8: "Serviços",
    9: "Serviços de Engenharia", 10: "Serviços de Saúde",
    11: "Alienação de bens móveis/imóveis",
}
MODALITY_NAMES = {
    1: "Leilão - Eletr.", 2: "Diálogo Competit.", 3: "Concurso",
    4: "Concorrência - Eletr.", 5: "Concorrência - Pres.",
    6: "Pregão - Eletr.", 7: "Pregão - Pres.", 8: "Dispensa",
    9: "Inexigibilidade", 10: "Manif. Interesse",
    11: "Pré-qualificação", 12: "Credenciamento", 13: "Leilão - Pres.",
}
CRITERION_NAMES = {
    1: "Menor preço", 2: "Maior desconto", 4: "Técnica e preço",
    5: "Maior lance", 6: "Maior ret. econôm.", 7: "Não se aplica",
    8: "Melhor técnica", 9: "Conteúdo artístico",
}
SPHERE_NAMES = {"F": "Federal", "E": "Estadual", "M": "Municipal", "D": "Distrital"}
POWER_NAMES = {"E": "Executivo", "L": "Legislativo", "J": "Judiciário"}
DOCUMENT_TYPE_NAMES = {
    1: "Aviso de Contratação Direta", 2: "Edital", 3: "Minuta do Contrato",
    4: "Termo de Referência", 5: "Anteprojeto", 6: "Projeto Básico",
    7: "Estudo Técnico Preliminar", 8: "Projeto Executivo", 9: "Mapa de Riscos",
    10: "DOD/DFD", 11: "Ata de Registro de Preço", 12: "Contrato",
    13: "Termo de Rescisão", 14: "Termo Aditivo", 15: "Termo de Apostilamento",
    17: "Nota de Empenho",
}
DOCUMENT_TYPE_PRIORITY = (4, 6, 7, 8, 5, 2, 3, 12, 14)
AMENDMENT_TYPE = 14
AMENDMENT_PHRASES = ("termo aditivo", "aditivo", "termo de aditamento")

# --- Fixed values: procedure rules ----------------------------------------------------
MODALITY_COMPETITION = (4, 5)
MODALITY_AUCTION = (6, 7)
MODALITY_DIALOGUE = (2,)
CRITERIA_COMPETITION = (1, 2, 4, 6, 8)
CRITERIA_AUCTION = (1, 2)

# --- Fixed values: bands --------------------------------------------------------------
MONEY_EDGES = (10_000, 50_000, 100_000, 500_000, 1_000_000, 5_000_000)
MONEY_LABELS = ("≤10k", "10-50k", "50-100k", "100-500k", "500k-1M", "1-5M", ">5M")
CONFIDENCE_EDGES = (0, 1, 2)
CONFIDENCE_LABELS = ("sem_sinal", "fraco_1", "moderado_2", "forte_3+")

# --- Fixed values: word lists ---------------------------------------------------------
STOPWORDS_CLEAN = """
a o e de da do das dos para por com sem em no na nos nas
um uma uns umas que se sua seu suas seus
ao aos à às pela pelo pelas pelos
ser estar ter haver há foi era são é como mas ou também já não nao sim
este esta esse essa aquele aquela isso aquilo isto
contratacao contratacoes contrato contratos servico servicos
empresa empresas fornecedor fornecedores fornecimento
prestacao prestar prestados prestada prestadas prestado
processo processos objeto objetos
pregao licitacao licitacoes edital editais
visa visando referente referentes refere
publica publico publicacao publicacoes administracao administrativa
municipio municipal estadual federal
art artigo lei n nº num numero numeros
conforme atender atendimento atende
itens item lote lotes
ata atas registro registros preco precos preços
tipo tipos descricao especificacao especificacoes
unidade unidades quantidade quantidades qtd
mes meses mensal anual ano anos dia dias periodo
""".split()

STOPWORDS_TOKEN = """
a ao aos aquela aquelas aquele aqueles aquilo as até
com como da das de dela delas dele deles depois
do dos e ela elas ele eles em entre era eram essa
essas esse esses esta estar estas este estou estes
eu foi for forma foi há isso isto já lhe lhes lo
mais mas me mesmo meu minha minha muito na não nas
nos nossa nossas nosso nossos num numa
o os ou para pela pelas pelo pelos por qual quando
que quem se sem ser seu seus sim sob sobre também
te tem têm teu tua tuas tudo um uma uns umas você vocês à às
contratação contratacao empresa serviço serviços
servico servicos prestação prestacao execução execucao
objeto conforme referência referencia termo edital
contrato mediante visando atender demanda necessidade
órgão orgao especializada especializado pessoa juridica
fornecimento aquisição aquisicao compra compras
sao paulo municipal municipio municipios
prefeitura secretaria distrito estadual federal
dia dias mes mes ano anos
""".split()

ENGINEERING_KEYWORDS = (
    "reforma obra obras construcao construção manutencao manutenção "
    "instalacao instalação pavimento pavimentacao drenagem estrutura "
    "eletrica elétrica hidraulica hidráulica topografia sondagem "
    "geotecnico geotécnico projeto projetos engenharia engenheiro "
    "art rrt spda incendio incêndio impermeabilizacao impermeabilização "
    "fundacao fundação alvenaria cobertura telhado esquadria "
    "climatizacao climatização ar-condicionado arcondicionado "
    "subestacao subestação cabeamento pintura revestimento piso pisos "
    "esgoto agua abastecimento"
).split()

SPECIAL_KEYWORDS = (
    "sondagem", "geotecnico", "geotécnico", "geotecnia",
    "fundacao", "fundação", "estaca", "estacas", "tirante", "tirantes",
    "contencao", "contenção", "talude", "muro de arrimo",
    "estrutural", "calculo estrutural", "cálculo estrutural",
    "concreto armado", "concreto protendido", "metalica", "metálica",
    "ponte", "pontes", "viaduto", "passarela",
    "subestacao", "subestação", "alta tensao", "alta tensão",
    "industrial", "automacao", "automação",
    "spda", "sistema de protecao contra descargas",
    "tratamento de efluente", "tratamento de esgoto",
    "estacao de tratamento", "estação de tratamento",
    "barragem", "bacia de contencao", "bacia de contenção",
    "impermeabilizacao especial", "impermeabilização especial",
    "perfuracao", "perfuração", "rebaixamento de lencol", "rebaixamento de lençol",
)

DOMAIN_TERMS = (
    "obra", "construcao", "reforma", "edificacao", "pavimentacao", "asfalto",
    "drenagem", "terraplenagem", "fundacao", "estrutura", "concreto", "armado",
    "alvenaria", "telhado", "cobertura", "instalacao eletrica", "hidraulica",
    "saneamento", "esgoto", "agua", "iluminacao publica", "ponte", "viaduto",
    "calcada", "meio fio", "guia", "sarjeta", "muro", "passarela", "rampa",
    "engenharia civil", "engenheiro", "art ", "crea",
    "memorial descritivo", "projeto executivo", "as built", "abnt nbr",
)

SPECIAL_WORK_INDICATORS = (
    "obra", "obras", "construcao", "construção", "edificacao", "edificação",
    "fundacao", "fundação", "estrutural", "estrutura", "metalica", "metálica",
    "movimentacao", "movimentação", "terra", "terraplenagem",
    "ponte", "pontes", "viaduto", "viadutos", "passarela",
    "subestacao", "subestação", "estacao", "estação", "tratamento",
    "barragem", "barragens", "tunel", "túnel", "tuneis", "túneis",
    "executivo", "anteprojeto", "projeto basico", "projeto básico",
    "geotecnico", "geotécnico", "geotecnia", "sondagem",
    "alta tensao", "alta tensão", "spda", "automacao", "automação",
    "industrial", "rodovia", "pavimentacao asfaltica", "pavimentação asfáltica",
    "recapeamento",
)
COMMON_SERVICE_INDICATORS = (
    "manutencao", "manutenção", "reparo", "reparos", "conservacao",
    "conservação", "adaptacao", "adaptação", "preventiva", "corretiva",
    "limpeza predial", "pintura predial", "iluminacao predial", "iluminação predial",
)

# --- Fixed values: patterns -----------------------------------------------------------
BOILERPLATE_PREFIXES = (
    r"^\s*o\s+objeto\s+d[eo]\s+presente\s+\w+\s+(é\s+|e\s+)?(a\s+|o\s+)?",
    r"^\s*registro\s+de\s+pre[çc]os?\s+(para\s+(a\s+)?)?(contrata[çc][ãa]o\s+(de\s+)?)?",
    r"^\s*contrata[çc][ãa]o\s+(de\s+)?(empresa\s+)?(especializada\s+)?"
    r"((para|em|na|no)\s+(a\s+)?)?(presta[çc][ãa]o\s+(de\s+)?)?(servi[çc]os?\s+(de\s+)?)?",
    r"^\s*presta[çc][ãa]o\s+de\s+servi[çc]os?\s+(de\s+)?",
    r"^\s*aquisi[çc][ãa]o\s+de\s+",
    r"^\s*fornecimento\s+de\s+",
    r"^\s*execu[çc][ãa]o\s+de\s+(servi[çc]os?\s+(de\s+)?)?",
    r"^\s*loca[çc][ãa]o\s+de\s+",
)

OBVIOUS_PATTERNS = (
    r"\bconstruc[aã]o\s+(de|do|da|dos|das)\s+"
    r"(predio|edif[ií]cio|escola|creche|posto|ubs|upa|hospital|"
    r"unidade\s+de|centro\s+de|gin[aá]sio|quadra|ponte|viaduto|"
    r"passarela|bueiro|muro|cerca|reservat[oó]rio|po[cç]o)\b",
    r"\breforma\s+(estrutural|predial|geral|completa|de\s+coberta|com\s+amplia[cç][aã]o)\b",
    r"\bampliac[aã]o\s+(de|do|da)\s+(predio|escola|hospital|ponte|edif[ií]cio|unidade)\b",
    r"\bpavimentac[aã]o\s+(asf[aá]ltica|com\s+asfalto|em\s+(cbuq|cbq)|"
    r"de\s+via|de\s+rua|paralelep[ií]pedo)\b",
    r"\brecapeamento\s+asf[aá]ltico\b",
    r"\bdrenagem\s+(pluvial|urbana|de\s+via|de\s+águas)\b",
    r"\bterraplenagem\b",
    r"\bcalcamento\s+(parael[ei]p[ií]pedo|em\s+pedra)\b",
    r"\bobra\s+civil\b",
    r"\bobra\s+de\s+arte\s+especial\b",
    r"\bedificac[aã]o\s+(nova|escolar|hospitalar|p[uú]blica)\b",
    r"\brede\s+de\s+(esgoto|[aá]gua|distribuic[aã]o\s+de)\b",
    r"\bestac[aã]o\s+de\s+(tratamento|elevac[aã]o|bombeamento)\b",
    r"\bsubestac[aã]o\s+el[eé]trica\b",
    r"\bestrutura\s+(met[aá]lica|de\s+concreto\s+armado)\b",
    r"\bconcreto\s+armado\b",
    r"\balvenaria\s+estrutural\b",
    r"\bprojeto\s+(b[aá]sico|executivo|estrutural|el[eé]trico|hidr[oô]\w+)\b",
    r"\bmemorial\s+descritivo\b",
    r"\bplanilha\s+or[cç]ament[aá]ria\b",
    r"\bart\s+(do\s+)?crea\b",
    r"\bengenharia\s+(civil|el[eé]trica|hidr[oô]\w+|sanit[aá]ria)\b",
)

COMPANY_NAME_PATTERNS = (
    r"\benhg\b", r"\bengenharia\b", r"\bconstrucoes?\b", r"\bconstrutora\b", r"\bobras?\b",
    r"\bedificacoes\b", r"\bempreendimentos\b", r"\binstalacoes\b",
    r"\bel[eé]trica\b", r"\bhidr[aá]ulica\b", r"\bproj(eto)?s?\b",
    r"\barquit(etura|et[oa]s?)\b", r"\bsane(amento)?\b",
    r"\bterra(planagem|planagem|plenagem)\b", r"\bpavimenta(c|c[ãa]o)\b",
)

CONTROL_KEY_PATTERN = r"^(\d{14})-(\d+)-(\d+)/(\d{4})$"
JSON_BLOCK_PATTERN = r"(?s)\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"

# Marker families of the base set (8).
MARKERS_BASE = {
    "ART": [r"\banota[çc][ãa]o\s+de\s+responsabilidade\s+t[ée]cnica\b",
            r"\bART\b(?:\s+do\s+CREA)?"],
    "CREA": [r"\bCREA[/\s\-]?\w{0,2}\b",
             r"\bConselho\s+Regional\s+de\s+Engenharia\b",
             r"\bregistro\s+(?:no\s+)?CREA\b"],
    "ENGENHEIRO_RESPONSAVEL": [r"\bengenheiro\s+respons[áa]vel\b",
                               r"\bengenheira?\s+respons[áa]vel\b",
                               r"\brespons[áa]vel\s+t[ée]cnico\b",
                               r"\bRT\s+do\s+(?:contrato|servi[çc]o|edital)\b"],
    "ATESTADO_CAP_TECNICA": [r"\bquadro\s+de\s+respons[áa]veis\s+t[ée]cnicos\b",
                             r"\batestado\s+de\s+capacidade\s+t[ée]cnica\b",
                             r"\bACT\b(?:\s+do\s+CREA)?"],
    "PROJETO_BASICO": [r"\bprojeto\s+b[áa]sico\b",
                       r"\banteprojeto\s+de\s+engenharia\b",
                       r"\bprojeto\s+executivo\b"],
    "OBRA_SERVICO_ENGENHARIA": [r"\bobra\s+de\s+engenharia\b",
                                r"\bservi[çc]o\s+(?:comum\s+)?de\s+engenharia\b",
                                r"\bservi[çc]o\s+especial\s+de\s+engenharia\b"],
    "ABNT_NORMA": [r"\bABNT\s+NBR\s*\d+",
                   r"\bnorma\s+t[ée]cnica\s+(?:NBR\s*\d+|brasileira)\b"],
    "LEI_14133_ENGENHARIA": [r"\bart\.?\s*6[°º]?,?\s*(?:inc(?:iso)?\.?\s*)?XII\b",
                             r"\bart\.?\s*6[°º]?,?\s*(?:inc(?:iso)?\.?\s*)?XX(?:I+)?\b"],
}

# Marker families of the document layer (10): the base set with architecture bodies.
MARKERS_DOCUMENT = {
    "ART": MARKERS_BASE["ART"],
    "RRT": [r"\bregistro\s+de\s+responsabilidade\s+t[ée]cnica\b",
            r"\bRRT\b(?:\s+do\s+CAU)?"],
    "CREA": MARKERS_BASE["CREA"],
    "CAU": [r"\bCAU[/\s\-]?\w{0,2}\b",
            r"\bConselho\s+de\s+Arquitetura\s+e\s+Urbanismo\b"],
    "ENGENHEIRO_RESPONSAVEL": MARKERS_BASE["ENGENHEIRO_RESPONSAVEL"],
    "ANOTACAO_RT": MARKERS_BASE["ATESTADO_CAP_TECNICA"],
    "PROJETO_BASICO": MARKERS_BASE["PROJETO_BASICO"],
    "OBRA_SERVICO_ENGENHARIA": MARKERS_BASE["OBRA_SERVICO_ENGENHARIA"],
    "LEI_14133_ENGENHARIA": MARKERS_BASE["LEI_14133_ENGENHARIA"],
    "ABNT_NORMAS_TECNICAS": MARKERS_BASE["ABNT_NORMA"],
}

# Marker families of the research method (12).
MARKERS_RESEARCH = {
    "ART": [r"\banota[çc][ãa]o\s+de\s+responsabilidade\s+t[ée]cnica\b",
            r"\bART\b(?:\s+do\s+CREA)?"],
    "CREA": [r"\bCREA[/\s\-]?\w{0,2}\b", r"\bConselho\s+Regional\s+de\s+Engenharia\b"],
    "ENGENHEIRO_RESP": [r"\bengenheir[oa]?\s+respons[áa]vel\b",
                        r"\brespons[áa]vel\s+t[ée]cnico\b"],
    "ATESTADO_CAP_TEC": [r"\batestado\s+de\s+capacidade\s+t[ée]cnica\b"],
    "PROJETO_BASICO": [r"\bprojeto\s+b[áa]sico\b", r"\bprojeto\s+executivo\b",
                       r"\bmemorial\s+descritivo\b"],
    "OBRA_SERV_ENG": [r"\bobra\s+de\s+engenharia\b", r"\bservi[çc]os?\s+de\s+engenharia\b"],
    "ABNT_NORMA": [r"\bABNT\s+NBR\s*\d+"],
    "LEI_14133_ENG": [r"\bart\.?\s*6[°º]?,?\s*(?:inc\.?\s*)?XII\b",
                      r"\bart\.?\s*6[°º]?,?\s*(?:inc\.?\s*)?XX(?:I+)?\b"],
    "PLANILHA_ORCAMENTARIA": [r"\bplanilha\s+or[çc]ament[áa]ria\b",
                              r"\bor[çc]amento\s+(sint[ée]tico|anal[íi]tico)\b",
                              r"\bcomposi[çc][ãa]o\s+de\s+custos\b",
                              r"\bBDI\b", r"\bSINAPI\b", r"\bSICRO\b"],
    "CRONOGRAMA_FIS_FIN": [r"\bcronograma\s+f[íi]sico[- ]financeiro\b"],
    "CADERNO_ENCARGOS": [r"\bcaderno\s+de\s+encargos\b", r"\bmemorial\s+de\s+c[áa]lculo\b"],
    "EXECUCAO_OBRA": [r"\balvar[áa]\s+de\s+constru[çc][ãa]o\b", r"\bhabite-?se\b",
                      r"\bdi[áa]rio\s+de\s+obras?\b", r"\bas[- ]?built\b"],
}

# Marker families of the operational product (9).
MARKERS_PRODUCT = {
    "ART/CREA": [r"\banota[çc][ãa]o\s+de\s+responsabilidade\s+t[ée]cnica\b",
                 r"\bART\b", r"\bCREA\b"],
    "Responsável técnico": [r"\brespons[áa]vel\s+t[ée]cnico\b",
                            r"\bengenheir[oa]?\s+respons[áa]vel\b"],
    "Projeto básico/executivo": [r"\bprojeto\s+b[áa]sico\b", r"\bprojeto\s+executivo\b",
                                 r"\bmemorial\s+descritivo\b"],
    "Planilha orçamentária": [r"\bplanilha\s+or[çc]ament[áa]ria\b",
                              r"\bcomposi[çc][ãa]o\s+de\s+custos\b"],
    "BDI": [r"\bBDI\b"],
    "SINAPI/SICRO": [r"\bSINAPI\b", r"\bSICRO\b"],
    "Cronograma físico-financeiro": [r"\bcronograma\s+f[íi]sico[- ]financeiro\b"],
    "Normas ABNT": [r"\bABNT\b", r"\bNBR\s*\d+"],
    "Atestado de cap. técnica": [r"\batestado\s+de\s+capacidade\s+t[ée]cnica\b"],
}

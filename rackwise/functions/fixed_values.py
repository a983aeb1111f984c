"""Schedule, thresholds and display texts that results must match exactly."""

# Fraction taken off the list price at each markdown stage; any other stage takes nothing off.
MARKDOWN_SCHEDULE = {0: "0.00", 1: "0.10", 2: "0.25", 3: "0.40"}

# Ids: leading text, text between month (YYMM) and counter, least digits of the counter.
CONSIGNOR_ID = ("C", "", 4)
SKU = ("BH-", "-", 4)
SALE_ID = ("V", "", 3)

# Share of a sale that goes to the consignor when none is recorded.
DEFAULT_PERCENT = 0.5

# Days an item must have been listed before it moves on to stage 1, 2 and 3.
MARKDOWN_AGES = {1: 30, 2: 60, 3: 90}

STAGE_LONG = {0: "Preço cheio (0%)", 1: "1º desconto (-10%)", 2: "2º desconto (-25%)", 3: "3º desconto (-40%)"}
STAGE_SHORT = {0: "Preço cheio", 1: "1º desconto", 2: "2º desconto", 3: "3º desconto"}
STAGE_PERCENT = {0: "0%", 1: "10%", 2: "25%", 3: "40%"}
STAGE_OTHER = "Outro"

PENDING_LABEL = {1: "Para 10% OFF", 2: "Para 25% OFF", 3: "Para 40% OFF"}

ACTION_MARKDOWN = "🏷️ Atualizar desconto de %d itens"
ACTION_OLD_ITEMS = "📦 Considerar bundle/doação de %d itens antigos (>90 dias)"
ACTION_OVERSTOCK = "⚠️ %d categorias com estoque alto (>20 itens)"
ACTION_NONE = "✅ Nenhuma ação urgente identificada. Estoque bem gerido!"

STATUS_ACTIVE = "✅ Ativo"
STATUS_INACTIVE = "❌ Inativo"
NO_VALUE = "—"

PRICE_TEXT = "R$ "
PERCENT_OFF_TEXT = "% OFF"
CONDITION_TEXT = "Estado: "

# A small label holds this many characters of description on one line, else two words on the first.
SMALL_LABEL_CHARACTERS = 15
SMALL_LABEL_WORDS = 2

# Categories offered for photography first.
PHOTO_CATEGORIES = ["Vestido", "Blazer", "Casaco", "Bolsa"]

# File name endings that count as photos, in order of preference. The match is case-sensitive.
PHOTO_EXTENSIONS = ["jpg", "jpeg", "png"]

PAYOUT_HEADINGS = {
    "consignor_id": "ConsignanteID",
    "name": "Nome",
    "qtd": "Peças",
    "total_net": "Vendas líquidas (R$)",
    "percent": "% Consignante",
    "consignor_value": "Valor p/ Consignante (R$)",
    "shop_value": "Valor p/ Loja (R$)",
    "pix_key": "Chave Pix",
}
PHOTO_LIST_HEADINGS = {
    "sku": "SKU",
    "category": "Categoria",
    "brand": "Marca",
    "size": "Tamanho",
    "list_price": "Preço",
}
KPI_HEADINGS = ["Estoque Atual", "Vendas (Período)", "Receita (Período)", "Taxa de Venda", "Dias p/ Vender"]

# Labels per sheet: columns and rows.
SHEET_2X4 = (2, 4)
SHEET_3X6 = (3, 6)

# Values the entry forms offer.
ACQUISITION_TYPES = ["consignação", "doação", "compra"]
CATEGORIES = [
    "Vestido", "Camisa", "Camiseta", "Calça", "Jeans", "Saia", "Blazer",
    "Casaco", "Short", "Macacão", "Sapato", "Bolsa", "Acessório",
]
GENDERS = ["F", "M", "Unissex"]
FITS = ["Ajustada", "Regular", "Ampla"]
CONDITIONS = ["A", "A-", "B", "C"]
CHANNELS = ["Loja", "Instagram", "WhatsApp", "Online"]
PAYMENT_METHODS = ["Débito", "Crédito", "Pix", "Dinheiro"]

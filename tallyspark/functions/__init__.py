"""Column-expression helpers built only from ``pyspark.sql.functions``.

They return ``Column`` objects, so everything stays inside whole-stage codegen;
no Python runs per row.
"""

from tallyspark.functions.text import (  # noqa: F401
    is_blank_php, php_trim, search_filter, text_present, ucfirst,
)
from tallyspark.functions.labels import (  # noqa: F401
    alert_message, availability_label, report_stock_class, stock_card_level,
    stock_label, stock_level_filter, status_badge, unit_label,
)
from tallyspark.functions.numeric import (  # noqa: F401
    fill_percent, format_money, unit_price,
)

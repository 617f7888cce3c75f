"""Typed errors raised by driver-side checks."""


class MeterError(Exception):
    """Base class; carries an English and a Persian message."""

    def __init__(self, english: str, persian: str):
        super().__init__(english)
        self.english = english
        self.persian = persian


class HourlyDateError(MeterError):
    def __init__(self):
        super().__init__(
            "interval readings need dates like YYYY-MM-DD hh:mm:ss",
            "قالب تاریخ داده‌های ساعتی باید YYYY-MM-DD hh:mm:ss باشد",
        )


class MonthlyDateError(MeterError):
    def __init__(self):
        super().__init__(
            "billing cycles need dates like YYYY-MM-DD",
            "قالب تاریخ داده‌های ماهانه باید YYYY-MM-DD باشد",
        )


class WrongColumnsError(MeterError):
    def __init__(self, found):
        super().__init__(
            f"expected 3 reading columns or 6 billing columns, found {list(found)}",
            "ستون‌های ورودی درست نیست",
        )


class WrongDateFormatError(MeterError):
    def __init__(self):
        super().__init__(
            "dates are neither Gregorian nor Jalali",
            "تاریخ‌ها نه میلادی و نه شمسی هستند",
        )


class UserNotFoundError(MeterError):
    def __init__(self, user_id):
        super().__init__(f"no readings for meter {user_id}", f"کنتور {user_id} پیدا نشد")
        self.user_id = user_id

"""Pattern banks: fixed values that results depend on, and their translation to Java syntax."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    """A context pattern; what it finds is its group `value`."""

    name: str
    entity_type: str
    score: float
    ignore_case: bool
    regex: str

    @property
    def java(self) -> str:
        """The pattern in Java syntax, with Unicode classes."""
        return ("(?iuU)" if self.ignore_case else "(?U)") + self.regex.replace("(?P<", "(?<")


@dataclass(frozen=True)
class Rule:
    """A weighted rule of the prompt-injection detector."""

    name: str
    category: str
    weight: float
    regex: str

    @property
    def java(self) -> str:
        return "(?iuU)" + self.regex


# Name, entity type, score, case-insensitive, pattern.
#: High-precision bank.
BASE_BANK = [
    Pattern("email", "EMAIL_ADDRESS", 0.95, True, r"(?P<value>\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b)"),
    Pattern("vn_mobile_phone", "PHONE_NUMBER", 0.85, True, r"(?<!\d)(?P<value>(?:\+?84|0)[ .-]?[35789](?:[ .-]?\d){8})(?!\d)"),
    Pattern("vn_cccd_cmnd", "ID", 0.9, True, r"(?:số\s*)?(?:cccd|cmnd|cmtnd|căn\s*cước(?:\s*công\s*dân)?|chứng\s*minh(?:\s*nhân\s*dân)?|thẻ\s*cccd)(?:\s*/\s*(?:cmnd|hc|id\s*no|thẻ\s*cccd))*\s*[:*]?\s*(?P<value>\d{12}|\d{9})"),
    Pattern("vn_cccd_loose_number", "ID", 0.86, True, r"(?:loại\s*[:*]?\s*cccd\b.{0,30}?số\s*[:*]?\s*)(?P<value>\d{12}|\d{9})"),
    Pattern("vn_tax_id", "ID", 0.88, True, r"mã\s*số\s*thuế\s*[:*]?\s*(?P<value>\d{10}(?:-\d{3})?)"),
    Pattern("vn_employee_id", "ID", 0.82, True, r"mã\s*nhân\s*viên\s*[:*]?\s*(?P<value>(?:[A-Z]{1,4}-\d{4}-\d{3,6})|(?:[A-Z]{1,4}\d{4,8})|(?:\d{6,12}))"),
    Pattern("vn_passport_id", "ID", 0.84, True, r"(?:hộ\s*chiếu|passport)(?:\s*số)?\s*[:*]?\s*(?P<value>[A-Z]\d{6,8})"),
    Pattern("vn_transaction_id", "ID", 0.8, True, r"mã\s*giao\s*dịch(?:\s+(?:mới\s+nhất|ngoại\s+tệ|nghi\s+vấn|cổ\s+tức|lưu\s+ký|thanh\s+toán))?\s*[:*]?\s*(?P<value>[A-Z]{2,}\d[A-Z0-9]{4,20}|\d{10,18})"),
    Pattern("vn_context_date", "DATE_TIME", 0.82, True, r"(?:ngày\s+(?!cấp\b)(?:sinh|họp|đào\s*tạo|hoàn\s*thành|làm\s*việc|phỏng\s*vấn|gửi|tiếp\s*nhận|đăng\s*ký|hiệu\s*lực|ký|khám(?:\s+gần\s+nhất)?|điều\s*trị|sao\s*kê|ghi\s*nhận|đánh\s*giá|phỏng\s*vấn\s+nâng\s*cao|hoàn\s*thành\s*khóa\s*học|kết\s*thúc\s*công\s*việc)|ngày\s*/\s*date|thời\s*điểm\s*ghi\s*nhận)\s*[:*]?\s*(?P<value>\d{1,2}/\d{1,2}/\d{4})"),
    Pattern("vn_context_year", "DATE_TIME", 0.76, True, r"(?:năm\s*tài\s*chính|cho\s+năm|của\s+năm|báo\s*cáo\s+tổng\s*hợp\s+năm)\s*(?P<value>(?:19|20)\d{2})"),
    Pattern("vn_context_month_duration", "DATE_TIME", 0.72, True, r"(?:sao\s*kê\s+tối\s*thiểu|trong\s+vòng|trong\s+khoảng|dữ\s*liệu\s+trong)\s*(?P<value>0?[1-9]|1[0-2])\s*tháng"),
    Pattern("vn_birth_year", "DATE_TIME", 0.78, True, r"năm\s*sinh\s*[:*]?\s*(?P<value>(?:19|20)\d{2})"),
    Pattern("vn_birth_month", "DATE_TIME", 0.78, True, r"tháng\s*sinh\s*[:*]?\s*(?P<value>0?[1-9]|1[0-2])\b"),
    Pattern("vn_house_number", "LOCATION", 0.74, False, r"(?P<value>Số\s+\d+[A-Z]?)\b(?=,?\s+(?:Đường|Phố|Ngõ|Ấp|Buôn|Bản|Xóm|Thôn|Phường|Xã|Huyện|Quận|Thị xã|Thành phố|Tỉnh|TP\.))"),
    Pattern("vn_street_like_location", "LOCATION", 0.74, False, r"(?P<value>(?:Đường|Phố|Ngõ|Ấp|Buôn|Bản|Xóm|Thôn)\s+(?!(?:Mã|Ngày|Số|Tên|Địa)\b)[A-ZÀ-Ỹ0-9][^,.;:\n]{0,45}?)(?=\s+(?:Phường|Xã|Huyện|Quận|Thị\s*xã|Thành\s*phố|Tỉnh|TP\.|Tên|Mã|Ngày|Số|Địa|$)|[,.;:\n]|$)"),
    Pattern("vn_ward_location", "LOCATION", 0.74, False, r"(?P<value>(?:Phường|Xã)\s+[A-ZÀ-Ỹ0-9][^,.;:\n]{0,40}?)(?=\s+(?:Huyện|Quận|Thị\s*xã|Thành\s*phố|Tỉnh|TP\.|Tên|Mã|Ngày|Số|Địa|$)|[,.;:\n]|$)"),
    Pattern("vn_district_location", "LOCATION", 0.74, False, r"(?<!Công an )(?P<value>(?:Huyện|Quận|Thị\s*xã|Thành\s*phố)\s+[A-ZÀ-Ỹ0-9](?:(?!\s+ngày\s+cấp\b)[^,.;:\n]){0,40}?)(?=\s+(?:Tỉnh|TP\.|Tên|Mã|Ngày|Số|Địa|$)|[,.;:\n]|$)"),
    Pattern("vn_province_location", "LOCATION", 0.74, False, r"(?P<value>(?:Tỉnh|TP\.)\s+[A-ZÀ-Ỹ0-9][^,.;:\n]{0,40}?)(?=\s+(?:Tên|Mã|Ngày|Số|Địa|Email|Liên|Cán\s*bộ|Thông\s*tin|Tọa\s*độ|$)|[,.;:\n]|$)"),
    Pattern("country_after_vn_address", "LOCATION", 0.7, False, r"(?:Tỉnh|TP\.)\s+[A-ZÀ-Ỹ0-9][^,.;:\n]{0,40},\s*(?P<value>[A-ZÀ-Ỹ][A-Za-zÀ-ỹ]*(?:\s+(?:và\s+)?[A-ZÀ-Ỹ][A-Za-zÀ-ỹ]*){0,4})(?=\s+(?:Thông\s*tin|Tọa\s*độ|Số\s*điện|Email|$))"),
    Pattern("vn_person_labeled_name", "PERSON", 0.8, False, r"(?:Họ\s+và\s+tên(?:\s+(?:chủ\s+thuê\s+bao|chủ\s+xe|nhân\s+viên|ứng\s+viên|đầy\s+đủ))?|Tên\s+(?:nhân\s+viên|ứng\s+viên|học\s+viên|chủ\s+hộ|người\s+nộp\s+thuế|trẻ\s+sơ\s+sinh)|Bệnh\s+nhân|Bác\s+sĩ\s+chuyên\s+môn|Người\s+đánh\s+giá|Người\s+ghi\s+biên\s+bản|Nhân\s+viên\s+phụ\s+trách)\s*[:*]\s*(?P<value>[A-ZÀ-Ỹ][A-Za-zÀ-ỹ'’]*(?:\s+[A-ZÀ-Ỹ][A-Za-zÀ-ỹ'’]*){1,5})(?=\s+(?:Mã|Ngày|Giới|Số|Học|Chức|Lĩnh|Địa|Quốc|Nhà|Trình|Tuổi|Bệnh|Tình|Vị|$)|$)"),
    Pattern("vn_person_split_surname", "PERSON", 0.72, False, r"\bHọ\s*[:*]\s*(?P<value>[A-ZÀ-Ỹ][A-Za-zÀ-ỹ'’]{1,20})(?=\s+Tên\s*[:*])"),
    Pattern("vn_person_split_given_name", "PERSON", 0.72, False, r"\bTên\s*[:*]\s*(?P<value>[A-ZÀ-Ỹ][A-Za-zÀ-ỹ'’]*(?:\s+[A-ZÀ-Ỹ][A-Za-zÀ-ỹ'’]*){0,3})(?=\s+(?:Họ\s+và\s+tên|Giới|Ngày|Mã|Số|Địa|$))"),
    Pattern("vn_person_honorific_narrative", "PERSON", 0.7, False, r"\b(?:Ông|Bà)\s+(?P<value>[A-ZÀ-Ỹ][A-Za-zÀ-ỹ'’]*(?:\s+[A-ZÀ-Ỹ][A-Za-zÀ-ỹ'’]*){1,3})(?=\s+(?:đã|xác|thực|người|nhận|cung|tiến|yêu))"),
    Pattern("vn_person_honorific_surname", "PERSON", 0.68, False, r"\b(?:Ông|Bà)\s+(?P<value>[A-ZÀ-Ỹ][A-Za-zÀ-ỹ'’]{1,20})(?=\s+[A-ZÀ-Ỹ][A-Za-zÀ-ỹ'’])"),
    Pattern("vn_person_honorific_given_name", "PERSON", 0.68, False, r"\b(?:Ông|Bà)\s+[A-ZÀ-Ỹ][A-Za-zÀ-ỹ'’]{1,20}\s+(?P<value>[A-ZÀ-Ỹ][A-Za-zÀ-ỹ'’]*(?:\s+[A-ZÀ-Ỹ][A-Za-zÀ-ỹ'’]*){0,2})(?=\s+(?:đã|xác|thực|người|nhận|cung|tiến|yêu|đăng|làm|vừa))"),
    Pattern("vn_organization_labeled", "ORGANIZATION", 0.78, False, r"(?:Tên\s+(?:tổ\s+chức|đơn\s+vị|ngân\s+hàng|cửa\s+hàng)(?:\s+(?:đào\s+tạo|tuyển\s+dụng|xác\s+nhận|phát\s+hành|bảo\s+lãnh|vận\s+tải|thực\s+hiện))?|Đơn\s+vị\s+(?:công\s+tác|làm\s+việc\s+gần\s+nhất)|Tại\s+Ngân\s+hàng\s*/\s*At\s+Bank|Bệnh\s+viện(?:\s+(?:điều\s+trị|thực\s+hiện))?|Bank)\s*[:*]?\s*(?P<value>[A-ZÀ-Ỹ][^:\n]{1,90}?)(?=\s+(?:Loại|Địa|Ngày|Lĩnh|Mã|Hạn|SWIFT|BIC|Số|Nội|Giá|Xếp|Chẩn|Bác|Tỉnh|Kho|Kế|Vị|I\.|$))"),
    Pattern("vn_bank_account", "BANK_ACCOUNT", 0.86, True, r"(?:số\s*tài\s*khoản|stk|tài\s*khoản\s+(?:người\s+(?:hưởng|ra\s+lệnh)|giao\s+dịch|lưu\s+ký|mở\s+mới|doanh\s+nghiệp|nhận\s+cổ\s+tức|nhận|chuyển|thanh\s+toán)|(?:dr\s+)?a/c\s+no(?:\s*/\s*serial)?)\s*[:*]?\s*(?P<value>\d(?:[ -]?\d){7,18})"),
    Pattern("url", "URL", 0.9, True, r"""(?P<value>\b(?:https?://|www\.)[^\s<>\"'\)\]]*[^\s<>\"'\)\].,;:!?])"""),
    Pattern("ipv4", "IP_ADDRESS", 0.9, True, r"(?<![\d.])(?P<value>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\d.])"),
    Pattern("ipv6", "IP_ADDRESS", 0.85, True, r"(?<![\w:])(?P<value>(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}|(?:[A-Fa-f0-9]{1,4}:){1,6}:[A-Fa-f0-9]{1,4}|(?:[A-Fa-f0-9]{1,4}:){1,5}(?::[A-Fa-f0-9]{1,4}){1,2}|(?:[A-Fa-f0-9]{1,4}:){1,4}(?::[A-Fa-f0-9]{1,4}){1,3}|(?:[A-Fa-f0-9]{1,4}:){1,3}(?::[A-Fa-f0-9]{1,4}){1,4}|(?:[A-Fa-f0-9]{1,4}:){1,2}(?::[A-Fa-f0-9]{1,4}){1,5}|[A-Fa-f0-9]{1,4}:(?::[A-Fa-f0-9]{1,4}){1,6}|::(?:[A-Fa-f0-9]{1,4}:){0,5}[A-Fa-f0-9]{1,4}|(?:[A-Fa-f0-9]{1,4}:){1,7}:)(?![\w:])"),
    Pattern("mac_address", "IP_ADDRESS", 0.9, True, r"(?<![\w:-])(?P<value>(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2})(?![\w:-])"),
    Pattern("crypto_ethereum", "CRYPTO", 0.95, True, r"(?<!\w)(?P<value>0x[a-fA-F0-9]{40})(?!\w)"),
    Pattern("crypto_bitcoin", "CRYPTO", 0.82, True, r"(?<!\w)(?P<value>(?:bc1[ac-hj-np-z02-9]{11,71}|[13][a-km-zA-HJ-NP-Z1-9]{25,34}))(?!\w)"),
    Pattern("crypto_litecoin", "CRYPTO", 0.78, True, r"(?<!\w)(?P<value>(?:ltc1[ac-hj-np-z02-9]{11,71}|[LM][a-km-zA-HJ-NP-Z1-9]{25,34}))(?!\w)"),
    Pattern("credit_card_grouped", "CREDIT_CARD", 0.85, True, r"(?<!\d)(?P<value>\d{4}(?:[ -]\d{4}){3})(?!\d)"),
    Pattern("credit_card_context", "CREDIT_CARD", 0.82, True, r"(?:số\s*thẻ(?:\s*tín\s*dụng)?|thẻ\s*tín\s*dụng|card\s*number)\s*[:*]?\s*(?P<value>\d{4}(?:[ -]?\d{4}){2,3}|\d{13,19})"),
    Pattern("card_cvv_context", "CREDIT_CARD", 0.8, True, r"(?:cvv|cvc|mã\s*bảo\s*mật(?:\s*thẻ)?(?:\s*cvv)?)\s*[:*]?\s*(?P<value>\d{3,4})(?!\d)"),
]
#: Broader bank for recall.
RECALL_BANK = [
    Pattern("recall_person_labeled_roles", "PERSON", 0.62, False, r"(?:Người\s+(?:phụ\s+trách|gửi\s+ticket|nhận|giao\s+tiền|yêu\s+cầu)|Tên\s+(?:người\s+yêu\s+cầu|bệnh\s+nhân|sản\s+phụ|trưởng\s+nhóm|tài\s+khoản\s+trích\s+nợ)|Nhân\s*viên|Đại\s*diện\s*[:*]?\s*Ông/bà|Bác\s+sĩ(?:\s+(?:kê\s+đơn|ICU\s+phụ\s+trách|cấp\s+cứu|sản\s+khoa|ký\s+xác\s+nhận))?|Cash\s*receiver|Delivered\s*by|Dr\s*A/C\s*name|Signature\s*&\s*full\s*name)\s*[:*]?\s*(?P<value>[A-ZÀ-Ỹ][A-Za-zÀ-ỹ'’]*(?:\s+[A-ZÀ-Ỹ][A-Za-zÀ-ỹ'’]*){1,5})(?=\s+(?:Mã|Ngày|Email|Số|Địa|Chức|Vị|Lĩnh|Bệnh|Tình|Nhiệm|Quá|Người|Tại|$)|$)"),
    Pattern("recall_date_labeled", "DATE_TIME", 0.65, True, r"ngày\s+(?!(?:cấp|cấp\s+đơn|hết\s+hạn)\b)[^0-9:\n]{0,45}?[:*]?\s*(?P<value>\d{1,2}/\d{1,2}/\d{4})"),
    Pattern("recall_date_today_clause", "DATE_TIME", 0.65, True, r"hôm\s+nay,\s*ngày\s+(?P<value>\d{1,2}/\d{1,2}/\d{4})"),
    Pattern("recall_context_year", "DATE_TIME", 0.58, True, r"(?:chuẩn\s+năm|tổng\s+hợp\s+năm|báo\s*cáo\s+năm|theo\s+năm|năm\s+tài\s+chính|cho\s+năm|của\s+năm)\s*(?P<value>(?:19|20)\d{2})"),
    Pattern("recall_context_month_duration", "DATE_TIME", 0.58, True, r"(?:thời\s*gian\s+sao\s*kê|sao\s*kê|trong\s+vòng|trong\s+khoảng|dữ\s*liệu\s+trong)\s*(?P<value>0?[1-9]|1[0-2])\s*tháng"),
    Pattern("recall_organization_labeled", "ORGANIZATION", 0.6, False, r"(?:Tên\s+(?:tổ\s+chức|ngân\s+hàng|công\s+ty|kho|doanh\s+nghiệp|đơn\s+vị)(?:\s+[A-Za-zÀ-ỹ/()]+){0,6}|Tổ\s*chức|Tên\s+công\s+ty|Kính\s+gửi|Chi\s+nhánh/Phòng\s+Giao\s+Dịch|Bên\s+(?:bảo\s+đảm|được\s+bảo\s+đảm))\s*[:*]?\s*(?P<value>[A-ZÀ-Ỹ][^:\n]{1,100}?)(?=\s+(?:Loại|Tổ|Số|Ngày|Địa|Mã|Lĩnh|Nội|Chức|Chi\s+nhánh|Kho|Vị|$))"),
    Pattern("recall_employee_id", "ID", 0.7, True, r"mã\s*nhân\s*viên\s*[:*]?\s*(?P<value>(?:[A-Z&]{1,5}-\d{4}-\d{3,6})|(?:[A-Z]{2,5}-EMP-\d{4,8})|(?:[A-Z]{2,5}-\d{4,8})|(?:20\d{2}-\d{4,8}))"),
    Pattern("recall_transaction_id", "ID", 0.68, True, r"mã\s*giao\s*dịch(?:\s+[A-Za-zÀ-ỹ]+){0,4}\s*[:*]?\s*(?P<value>[A-Z]{2,}\d?[A-Z0-9]{6,24}|\d{10,18})"),
    Pattern("recall_business_tax_id", "ID", 0.68, True, r"(?:mã\s*số\s*(?:doanh\s*nghiệp|thuế(?:\s+hộ\s+kinh\s+doanh)?)|ĐKDN/ĐKKD/QĐTL\s+số)\s*[:*]?\s*(?P<value>\d{10}(?:-\d{3})?)"),
    Pattern("recall_document_number", "ID", 0.68, True, r"(?:CMND/CCCD\s*Số|Căn\s*cước\s*công\s*dân\s*số|Số\s+GTTT|Số\s+Thẻ\s+CCCD\s*/HC/\s*/Giấy\s+tờ\s+khác|Số\s+hộ\s*chiếu|passport\s*number)\s*[:*]?\s*(?P<value>[A-Z]\d{6,8}|\d{9}|\d{12})"),
    Pattern("recall_bank_account", "BANK_ACCOUNT", 0.7, True, r"(?:tài\s*khoản\s+(?:công\s+ty\s+liên\s+kết|liên\s+kết|ví\s+liên\s+kết|tài\s+chính\s+liên\s+kết|chứng\s+khoán|giao\s+dịch\s+chứng\s+khoán|thanh\s+toán\s+số)|số\s+tài\s*khoản\s+(?:nhận\s+lương|người\s+nhận|liên\s+kết|tiết\s+kiệm)|số\s+ví\s+thanh\s+toán|ví\s+thanh\s+toán)\s*[:*]?\s*(?P<value>\d(?:[ -]?\d){7,18})"),
    Pattern("recall_country_labeled", "LOCATION", 0.58, False, r"(?:quốc\s*gia|country)\s*[:*]?\s*(?P<value>[A-ZÀ-Ỹ][A-Za-zÀ-ỹ]*(?:\s+(?:và\s+)?[A-ZÀ-Ỹ][A-Za-zÀ-ỹ]*){0,4}?)(?=\s+(?:Mã|Địa|Tổng|$)|[,.;:\n]|$)"),
    Pattern("recall_country_after_address", "LOCATION", 0.58, False, r"(?:Tỉnh|TP\.|Thành\s+phố)\s+[A-ZÀ-Ỹ0-9][^,.;:\n]{0,45},\s*(?P<value>[A-ZÀ-Ỹ][A-Za-zÀ-ỹ]*(?:\s+(?:và\s+)?[A-ZÀ-Ỹ][A-Za-zÀ-ỹ]*){0,4}?)(?=\s+(?:Mã|Tọa|Hướng|Điểm|Địa|$)|[,.;:\n]|$)"),
    Pattern("recall_special_ward", "LOCATION", 0.58, False, r"(?P<value>Đặc\s+khu\s+[A-ZÀ-Ỹ][^,.;:\n]{1,35}?)(?=\s+(?:Huyện|Tỉnh|Thành\s+phố|TP\.|$)|[,.;:\n]|$)"),
]
#: Bank for the second corpus.
VIE_BANK = [
    Pattern("vie_pii_labeled_person", "PERSON", 0.6, False, r"(?:Họ\s*Tên|Họ\s+và\s+tên|Tên\s+(?:Khách(?:\s+Mời)?|Khách\s+hàng|Bệnh\s+nhân|Liên\s+hệ)|\*\*Tên\*\*)\s*[:*]?\s*(?P<value>[A-ZÀ-Ỹ][A-Za-zÀ-ỹ.'’-]*(?:\s+[A-ZÀ-Ỹ][A-Za-zÀ-ỹ.'’-]*){0,4})(?=\s+(?:-|Ngày|Mã|Số|Email|Địa|Nghề|Giới|Date|Phone|$)|[,.;\n]|$)"),
    Pattern("vie_pii_company_name", "ORGANIZATION", 0.58, False, r"(?P<value>(?:Công\s+ty|Tập\s+đoàn|Bệnh\s+viện|Khách\s+sạn|Dược\s+phẩm|Trường|Đại\s+học|Ngân\s+hàng|Nhà\s+thuốc)\s+[A-ZÀ-Ỹ][^,.;:\n]{1,80}?)(?=\s+(?:đã|có|tại|và|Mã|Số|Ngày|Địa|Phone|Email|\*\*|$)|[,.;:\n]|$)"),
    Pattern("vie_pii_labeled_company_name", "ORGANIZATION", 0.56, False, r"(?:Tên\s+(?:công\s+ty|khách\s+sạn|tổ\s+chức)|Company\s+Name|Hotel\s+Name|liên\s+hệ\s*:?)\s*[:*]?\s*(?P<value>[A-ZÀ-Ỹ][A-Za-zÀ-ỹ0-9&.'’/-]*(?:\s+[A-ZÀ-Ỹ][A-Za-zÀ-ỹ0-9&.'’/-]*){0,7})(?=\s+(?:Mã|Số|Ngày|Địa|Project|Company|\*\*|$)|[,.;:\n]|$)"),
    Pattern("vie_pii_context_id", "ID", 0.62, True, r"(?:Mã\s+(?:số\s+)?(?:khách\s+hàng|hồ\s+sơ|hồ\s+sơ\s+bệnh\s+án|định\s+danh\s+sinh\s+trắc\s+học|nhân\s+viên|giao\s+dịch)|Số\s+(?:Hồ\s+Sơ\s+Bệnh\s+Án|giấy\s+phép\s+chứng\s+nhận|giấy\s+phép|thẻ\s+bảo\s+hiểm\s+y\s+tế|định\s+tuyến\s+ngân\s+hàng|An\s+Sinh\s+Xã\s+Hội)|employee\s+(?:id|ID)|certificate\s+license\s+number|license\s+number|swift\s*bic)\s*[:*]?\s*(?P<value>[A-Z0-9][A-Z0-9-]{3,28}|\d{4,18})"),
    Pattern("vie_pii_labeled_datetime", "DATE_TIME", 0.58, True, r"(?:lúc|vào\s+lúc|ngày(?:/giờ)?|Ngày\s+(?:Nhận\s+Phòng|Trả\s+Phòng|Hóa\s+Đơn)|Project\s+Date|Date\s+of\s+Birth|thời\s+gian\s+nhận\s+phòng|kiểm\s+tra\s+lần\s+cuối\s+vào)\s*[:*]?\s*(?P<value>(?:\d{1,2}/\d{1,2}/\d{4})|(?:\d{1,2}:\d{2}(?::\d{2})?(?:\s*(?:SA|CH|AM|PM))?))"),
    Pattern("vie_pii_international_phone_context", "PHONE_NUMBER", 0.58, True, r"(?:số\s+(?:điện\s+thoại|fax)|phone\s+number|fax|gọi|liên\s+hệ(?:\s+với\s+chúng\s+tôi)?\s+(?:theo|qua))\s*[:*]?\s*(?P<value>(?:\+\d{1,3}[\s.-]?)?(?:\d[\s.-]?){7,15}\d)"),
]
# Name, category, weight, pattern (all case-insensitive).
RULES = [
    Rule("ignore_previous_instructions", "instruction_override", 0.75, r"\b(?:bỏ\s+qua|lờ\s+đi|quên|không\s+tuân\s+theo|đừng\s+làm\s+theo|đừng\s+tuân\s+thủ|ghi\s+đè|ignore|forget|disregard|override)\b.{0,80}?\b(?:hướng\s+dẫn|chỉ\s+dẫn|quy\s+tắc|lệnh|nội\s+dung|system\s+message|system\s+prompt|instruction|instructions|rule|rules|prompt)\b.{0,50}?\b(?:trước|ban\s+đầu|hệ\s+thống|previous|prior|above|system)?\b"),
    Rule("prefer_user_instruction_over_system", "instruction_override", 0.75, r"\b(?:ưu\s+tiên|làm\s+theo|tuân\s+theo|follow|prioritize)\b.{0,80}?\b(?:chỉ\s+dẫn|hướng\s+dẫn|instruction|instructions?)\b.{0,80}?\b(?:của\s+tôi|người\s+dùng|user)\b.{0,80}?\b(?:hơn|thay\s+vì|over|instead\s+of)\b.{0,80}?\b(?:developer\s+message|system\s+message|system\s+prompt|quy\s+tắc|hệ\s+thống)\b"),
    Rule("reveal_hidden_prompt", "secret_extraction", 0.7, r"\b(?:tiết\s+lộ|in\s+ra|hiển\s+thị|cho\s+tôi\s+xem|nói\s+cho\s+tôi|xuất\s+ra|show|print|reveal|display)\b.{0,80}?\b(?:system\s+prompt|developer\s+message|lời\s+nhắc\s+hệ\s+thống|chỉ\s+dẫn\s+hệ\s+thống|prompt\s+ẩn|nội\s+dung\s+ẩn|quy\s+tắc\s+nội\s+bộ|hidden\s+prompt|internal\s+rules?)\b"),
    Rule("print_system_prompt", "secret_extraction", 0.7, r"\b(?:in|print|show|display)\b.{0,35}?\b(?:system\s+prompt|developer\s+message|hidden\s+prompt|internal\s+rules?)\b"),
    Rule("policy_bypass", "jailbreak", 0.55, r"\b(?:vượt\s+qua|bỏ\s+qua|né|phá|tắt|bypass|disable|turn\s+off|ignore|override)\b.{0,70}?\b(?:chính\s+sách|bộ\s+lọc|guardrail|kiểm\s+duyệt|an\s+toàn|hạn\s+chế|safety|filter|policy|restriction)\b"),
    Rule("unsafe_roleplay", "jailbreak", 0.5, r"\b(?:đóng\s+vai|giả\s+vờ\s+là|hãy\s+là|act\s+as|pretend\s+to\s+be)\b.{0,70}?\b(?:dan|không\s+bị\s+ràng\s+buộc|không\s+có\s+giới\s+hạn|chế\s+độ\s+nhà\s+phát\s+triển|unrestricted|no\s+limits?|developer\s+mode)\b"),
    Rule("tool_permission_bypass", "tool_abuse", 0.75, r"\b(?:gọi|chạy|thực\s+thi|sử\s+dụng|dùng|call|run|execute|use)\b.{0,80}?\b(?:công\s+cụ|tool|api|database|lệnh|terminal|shell)\b.{0,120}?\b(?:không\s+cần|bỏ\s+qua|đừng|without|skip|don't|do\s+not)\b.{0,45}?\b(?:xin\s+phép|quyền|xác\s+nhận|hỏi\s+lại|permission|confirmation|approval)\b"),
    Rule("permission_bypass_before_tool", "tool_abuse", 0.75, r"\b(?:không\s+hỏi\s+lại|không\s+cần|bỏ\s+qua|bypass|không\s+hỏi\s+xác\s+nhận|without|skip|don't|do\s+not)\b.{0,55}?\b(?:xin\s+phép|quyền|xác\s+nhận|hỏi\s+lại|permission|confirmation|approval)?\b.{0,90}?\b(?:gọi|chạy|thực\s+thi|call|execute|run)\b.{0,45}?\b(?:tool|api|database|lệnh|terminal|shell|command)\b"),
    Rule("direct_shell_permission_bypass", "tool_abuse", 0.75, r"\b(?:shell|terminal)\b.{0,80}?\b(?:không\s+cần|bỏ\s+qua|đừng|without|skip|don't|do\s+not)\b.{0,45}?\b(?:xin\s+phép|quyền|xác\s+nhận|hỏi\s+lại|permission|confirmation|approval)\b"),
    Rule("secret_or_data_exfiltration", "data_exfiltration", 0.65, r"(?:\b(?:lấy|trích\s+xuất|gửi|liệt\s+kê|xuất\s+ra|xuất|đọc\s+toàn\s+bộ|đọc|extract|send|list|dump|read)\b.{0,90}?\b(?:mật\s+khẩu|token|api\s*key|khóa\s+api|secret|credentials?|password|thông\s+tin\s+ẩn)\b|\b(?:lấy|trích\s+xuất|gửi|liệt\s+kê|xuất\s+ra|xuất|đọc\s+toàn\s+bộ|extract|send|list|dump)\b.{0,90}?\b(?:dữ\s+liệu\s+người\s+dùng|user\s+data|dữ\s+liệu\s+cá\s+nhân|lịch\s+sử\s+chat|thông\s+tin\s+cá\s+nhân)\b)"),
    Rule("production_config_secret_access", "data_exfiltration", 0.75, r"\b(?:đọc|lấy|trích\s+xuất|read|extract)\b.{0,80}?\b(?:file\s+cấu\s+hình|config|configuration)\b.{0,50}?\b(?:production|prod|nội\s+bộ)\b.{0,80}?\b(?:api\s*key|khóa\s+api|secret|token|credentials?)\b"),
    Rule("external_secret_exfiltration", "data_exfiltration", 0.75, r"\b(?:gửi|send|dump|đọc|read)\b.{0,90}?\b(?:secret|credentials?|token|mật\s+khẩu|file\s+cấu\s+hình|lịch\s+sử\s+chat|dữ\s+liệu\s+người\s+dùng|dữ\s+liệu\s+cá\s+nhân|thông\s+tin\s+cá\s+nhân)\b.{0,80}?\b(?:webhook|bên\s+ngoài|external)\b"),
    Rule("credential_dump", "data_exfiltration", 0.75, r"\b(?:dump|xuất\s+ra|liệt\s+kê)\b.{0,70}?\b(?:credentials?|secret|token)\b"),
    Rule("encoded_instruction", "obfuscation", 0.45, r"\b(?:giải\s+mã|decode|base64|mã\s+hóa|chuỗi\s+đã\s+mã\s+hóa|encoded)\b.{0,90}?\b(?:làm\s+theo|thực\s+hiện|chạy|tuân\s+theo|follow|execute|run)\b"),
    Rule("retrieved_context_instruction", "indirect_injection", 0.75, r"\b(?:trong\s+tài\s+liệu|tài\s+liệu\s+trợ\s+giúp|nội\s+dung\s+truy\s+xuất|retrieved\s+context|document\s+says)\b.{0,100}?\b(?:bỏ\s+qua|ignore|làm\s+theo|follow)\b.{0,80}?\b(?:hướng\s+dẫn|instructions?|system\s+prompt|quy\s+tắc)\b"),
]
#: Markers of a benign discussion (benign).
BENIGN_MARKERS = [
    "giải thích",
    "viết cảnh báo",
    "dấu hiệu",
    "bài học",
    "checklist",
    "không nên yêu cầu",
    "phòng chống",
    "bảo vệ",
    "kiểm thử",
    "kiểm tra câu sau",
    "đánh giá yêu cầu",
    "nhận diện",
    "trích dẫn",
    "bằng chứng tấn công",
    "đoạn mô phỏng",
    "phân loại",
    "không làm theo",
    "không thực hiện",
    "chỉ trả lời",
    "chính sách nội bộ",
    "tóm tắt chính sách",
    "log mẫu",
    "redacted",
]
#: Markers of a benign discussion (topic).
TOPIC_MARKERS = [
    "prompt injection",
    "rủi ro",
    "dấu hiệu",
    "không nên",
    "bảo vệ",
    "bảo mật",
    "độc hại",
    "nguy hiểm",
    "hướng dẫn hệ thống",
    "developer message",
    "không làm theo",
    "không thực hiện",
    "redacted",
]
#: Gold label to entity type.
MASKING_LABELS = {
    "HO_VA_TEN": "PERSON",
    "HO": "PERSON",
    "TEN": "PERSON",
    "TEN_DEM": "PERSON",
    "DANH_XUNG": "PERSON",
    "NGAY": "DATE_TIME",
    "NGAY_SINH": "DATE_TIME",
    "THANG": "DATE_TIME",
    "NAM": "DATE_TIME",
    "THOI_GIAN": "DATE_TIME",
    "NGAY_CAP": "DATE_TIME",
    "HAN_THE_TIN_DUNG": "DATE_TIME",
    "SO_DIEN_THOAI": "PHONE_NUMBER",
    "DIA_CHI_EMAIL": "EMAIL_ADDRESS",
    "THANH_PHO_TINH": "LOCATION",
    "QUAN_HUYEN": "LOCATION",
    "PHUONG_XA": "LOCATION",
    "DUONG_PHO": "LOCATION",
    "SO_NHA_TOA_NHA": "LOCATION",
    "QUOC_GIA": "LOCATION",
    "TOA_DO_DIA_LY": "LOCATION",
    "MA_BUU_CHINH": "LOCATION",
    "PHUONG_HUONG": "LOCATION",
    "TEN_TO_CHUC": "ORGANIZATION",
    "TEN_NGAN_HANG": "ORGANIZATION",
    "LOAI_HINH_TO_CHUC": "ORGANIZATION",
    "TO_CHUC_CONG_TY_BAO_HIEM": "ORGANIZATION",
    "TO_CHUC_PHAT_HANH_THE": "ORGANIZATION",
    "TEN_BENH_VIEN": "ORGANIZATION",
    "NHA_MANG": "ORGANIZATION",
    "CO_QUAN_CAP": "ORGANIZATION",
    "SO_TAI_KHOAN": "BANK_ACCOUNT",
    "MA_BIC_SWIFT_NGAN_HANG": "BANK_ACCOUNT",
    "MA_NHAN_VIEN": "ID",
    "MA_GIAO_DICH": "ID",
    "MA_SO_THUE": "ID",
    "SO_CCCD_CMND": "ID",
    "SO_HO_CHIEU": "ID",
    "SO_TAI_LIEU": "ID",
    "SO_HOP_DONG_MA_SO_CHINH_SACH": "ID",
    "MA_SINH_VIEN": "ID",
    "MA_BENH_AN": "ID",
    "MA_KHACH_HANG": "ID",
    "SO_GIAY_PHEP_LAI_XE": "ID",
    "SO_THE_BAO_HIEM_Y_TE": "ID",
    "SO_AN_SINH_XA_HOI_MA_BHXH": "ID",
    "MA_IMEI_DIEN_THOAI": "ID",
    "SO_THE_TIN_DUNG": "CREDIT_CARD",
    "SO_THE": "CREDIT_CARD",
    "MA_BAO_MAT_THE_CVV": "CREDIT_CARD",
    "DIA_CHI_VI_ETHEREUM": "CRYPTO",
    "DIA_CHI_VI_BITCOIN": "CRYPTO",
    "DIA_CHI_VI_LITECOIN": "CRYPTO",
    "DIA_CHI_IP": "IP_ADDRESS",
    "DIA_CHI_IPV4": "IP_ADDRESS",
    "DIA_CHI_IPV6": "IP_ADDRESS",
    "DIA_CHI_MAC": "IP_ADDRESS",
    "DUONG_DAN_URL": "URL",
    "MAT_KHAU": "CREDENTIAL",
    "MA_OTP": "CREDENTIAL",
    "MA_PIN": "CREDENTIAL",
    "KHOA_API": "CREDENTIAL",
    "CHUOI_DINH_DANH_TRINH_DUYET": "CREDENTIAL",
    "SO_TIEN": "FINANCIAL",
    "MUC_LUONG_THU_NHAP": "FINANCIAL",
    "SO_DU": "FINANCIAL",
    "XEP_HANG_TIN_DUNG": "FINANCIAL",
    "CHAN_DOAN": "MEDICAL",
    "KET_QUA_XET_NGHIEM": "MEDICAL",
    "QUA_TRINH_DIEU_TRI": "MEDICAL",
    "BENH_MAN_TINH": "MEDICAL",
    "DON_THUOC": "MEDICAL",
    "DUNG_THUOC": "MEDICAL",
    "DI_UNG": "MEDICAL",
    "THONG_TIN_DI_TRUYEN": "MEDICAL",
    "NHOM_MAU": "MEDICAL",
    "TINH_TRANG_TIEM_CHUNG": "MEDICAL",
    "TINH_TRANG_THAI_KY": "MEDICAL",
    "THONG_TIN_SUC_KHOE_TAM_THAN": "MEDICAL",
    "TINH_TRANG_KHUYET_TAT": "MEDICAL",
    "CAN_NANG": "MEDICAL",
    "CHIEU_CAO": "MEDICAL",
    "SO_DUOC_CHE_MOT_PHAN": "MEDICAL",
    "BIEN_SO_XE": "VEHICLE",
    "SO_KHUNG_XE": "VEHICLE",
    "LOAI_PHUONG_TIEN": "VEHICLE",
    "HANG_XE": "VEHICLE",
    "TEN_NGUOI_DUNG_TAI_KHOAN": "USERNAME",
    "TEN_TAI_KHOAN": "USERNAME",
    "TON_GIAO": "NRP",
    "QUOC_TICH": "NRP",
    "GIOI_TINH": "NRP",
    "GIOI_TINH_SINH_HOC": "NRP",
    "THANH_PHAN_XA_HOI": "NRP",
    "TUOI": "NRP",
    "LINH_VUC_NGHE_NGHIEP": "OCCUPATION",
    "CHUC_DANH_CONG_VIEC": "OCCUPATION",
    "LOAI_HINH_CONG_VIEC": "OCCUPATION",
    "MA_NGHE_NGHIEP": "OCCUPATION",
    "TRINH_DO_HOC_VAN": "EDUCATION",
    "HOC_VI": "EDUCATION",
    "TEN_TAI_SAN": "PROPERTY",
    "TAI_SAN": "PROPERTY",
    "SO_DO": "PROPERTY",
    "SO_THUA_DAT": "PROPERTY",
}
#: Gold labels that name no personal data.
DROPPED_LABELS = [
    "LOAI_TIEN_TE",
    "TY_GIA_HOI_DOAI",
    "NGON_NGU",
    "MUI_GIO",
    "MA_SAN_BAY",
    "MA_GA_TRAM",
]
#: Gold label to entity type.
VIE_LABELS = {
    "human_name": "PERSON",
    "address": "LOCATION",
    "company_name": "ORGANIZATION",
    "phone_number": "PHONE_NUMBER",
    "email_address": "EMAIL_ADDRESS",
    "id_number": "ID",
    "date": "DATE_TIME",
}

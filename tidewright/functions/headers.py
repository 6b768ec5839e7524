"""Names of columns as files have them, and the columns that they stand for."""

# Columns of a mail file, in order, and what they are called elsewhere.
MAIL = {
    "KeyCode": ["key code", "keycode", "key_code", "key"],
    "Cust": ["customer number", "customer #", "cust number", "cust #", "customer no", "customernumber", "custno", "cust no", "customer id", "custid"],
    "Seg": ["customer segment", "segment", "seg", "cust segment", "customerseg"],
    "Sls#": ["sls#", "sls #", "sales #", "sales rep #", "salesrep", "sales rep number", "slsnum", "sales number", "slsno"],
    "Rep Name": ["rep name", "sales rep", "sales rep name", "rep", "salesperson", "sales person"],
    "Company": ["company", "company name", "organization", "org", "account name", "business name", "firm"],
    "Address1": ["address1", "address 1", "street", "street address", "address line 1", "addr1", "address line1", "mailing address", "address"],
    "Address2": ["address2", "address 2", "address line 2", "addr2", "suite", "unit", "apt", "address line2"],
    "City": ["city", "town", "municipality"],
    "State": ["state", "st", "province", "state code"],
    "Zip": ["zip", "zip code", "postal", "postal code", "zipcode", "postcode", "zip+4"],
    "Contact": ["contact", "contact name", "full name", "name", "attn", "attention"],
    "Title": ["title", "job title", "position", "role", "job role", "designation"],
    "Telephone": ["telephone", "phone", "phone number", "tel", "mobile", "cell", "fax", "direct", "phone #"],
    "Seqno": ["seqno", "seq no", "sequence", "seq number", "sequence number"],
    "Ssqno": ["ssqno", "ssq no", "subsequence", "ssq number"],
    "Service": ["service", "svc", "service type"],
    "Wt": ["wt", "weight", "mail weight"],
    "Type": ["type", "record type", "rec type"],
    "Billto": ["billto", "bill to", "billing", "bill-to", "billing account"],
    "USPSConf": ["uspsconf", "usps conf", "usps confirmation", "usps", "postal confirmation"],
    "Email Address": ["email", "email address", "e-mail", "emailaddress", "e mail", "email addr", "email_address"],
    "SQL": ["sql", "sales qualified lead", "qualified lead", "sql flag"],
    "Sugar Lead Source": ["sugar lead source", "lead source", "source", "crm lead source", "lead_source"],
}
# Columns of a mail file that most files lack.
MAIL_BLANK = ["KeyCode", "Seqno", "Ssqno", "Service", "Wt", "Type", "Billto", "USPSConf"]
# Columns of a letter, in order, each with the column of a mail file that it is; the last is put together.
LETTER = {"KeyCode": "KeyCode", "Contact": "Contact", "Title": "Title", "Company": "Company", "Address 2": "Address2", "Address 1": "Address1", "City, State, Zip": None}
CONTACTS = ["contact", "contact name", "full name", "attn"]
FIRST_NAMES = ["first name", "firstname", "fname", "given name", "first", "givenname"]
LAST_NAMES = ["last name", "lastname", "lname", "surname", "family name", "last", "familyname"]

# Columns of the standard format, in order, with their aliases; the later ones are optional.
STANDARD = {
    "Customer": ["Customer#", "Customer_ID", "Cust#", "Customer_Number", "Customer Number", "Cust_ID", "CustomerID", "CustNum"],
    "Segment": ["Segment#", "Customer_Segment", "Segment_ID", "Customer Segment", "Segment Number", "SegmentID"],
    "Salesman #": ["Salesman_ID", "Sales_Rep_#", "Rep#", "Salesman_Number", "Sales Rep #", "Rep Number", "SalesmanID"],
    "Salesman Name": ["Sales_Rep_Name", "Rep_Name", "Salesman", "Sales Rep Name", "Sales Representative", "Rep Name"],
    "Company": ["Company_Name", "Organization", "Account", "Business", "Firm", "CompanyName", "Business Name"],
    "Address 1": ["Street", "Street_Address", "Address_Line_1", "Address Line 1", "Address1", "Street Address", "Addr1"],
    "Address 2": ["Suite", "Unit", "Address_Line_2", "Address Line 2", "Address2", "Addr2", "Apartment", "Apt"],
    "City": ["Town", "Municipality"],
    "State": ["State_Code", "Province", "ST", "State Code"],
    "Zip": ["Zip_Code", "Postal_Code", "ZIP", "Zip Code", "Postal Code", "ZipCode", "PostalCode"],
    "Phone": ["Phone_Number", "Contact_Phone", "Phone_Direct", "Direct_Phone", "Phone Number", "Telephone", "Tel", "Ph"],
    "Contact": ["Customer_Name", "Contact_Name", "Full_Name", "Name", "Customer Name", "Contact Name", "ContactName"],
    "Title": ["Job_Title", "Position", "Role", "Job Title", "JobTitle"],
    "Email": ["Email_Address", "Email_Contact", "E_Mail", "Email Address", "EmailAddress", "E-Mail"],
}
STANDARD_OPTIONAL = {
    "Industry": ["Industry_Type", "Business_Type", "Sector"],
    "Company Size": ["Employees", "Employee_Count", "Company_Size", "CompanySize", "Num_Employees"],
    "Revenue": ["Annual_Revenue", "Sales_Volume", "Company_Revenue"],
    "Management Level": ["Management_Level", "Level", "Seniority"],
    "Job Function": ["Job_Function", "Department", "Function"],
    "Website": ["Company_Website", "URL", "Web_Address", "Domain"],
    "LinkedIn": ["LinkedIn_URL", "LinkedIn_Profile", "LinkedIn"],
}
STANDARD_REQUIRED = ["Company", "Address 1", "City", "State", "Zip", "Phone", "Email"]
# Names of columns that the standard format doesn't want; a star stands for anything.
UNWANTED = {
    "internal_ids": ["*ZoomInfo*", "*Salesforce*", "*HubSpot*", "*LinkedIn_ID*", "*Record_ID*", "*Import_ID*", "*Contact_ID", "*Account_ID", "*Lead_ID", "*_Internal_*"],
    "metadata": ["Last_Updated", "Last Updated", "Data_Source", "Data Source", "Import_Date", "Import Date", "*_Timestamp", "Created_Date", "Modified_Date", "Export_Date", "Updated_*"],
    "confidence_scores": ["Confidence*", "*_Confidence", "*_Quality_Score", "Data_Quality*", "*_Score", "Match_Score", "Accuracy_*"],
    "duplicate_fields": ["Phone_Alternate", "Email_Alternate", "Mobile_Phone", "Work_Phone", "Fax*"],
    "deprecated": ["Legacy_*", "Old_*", "*_Deprecated", "*_Archived"],
}
# Words by which rows above a header are told.
ABOVE_HEADERS = ["Export", "Report", "Data", "Sheet", "Generated", "Date:", "Time:", "Source:", "From:", "File:"]
# Columns by which a vendor's export of contacts is told, and those of its variant for mailings.
VENDOR_IDS = ["ZoomInfo Contact ID", "ZoomInfo Company ID", "ZoomInfo Contact Profile URL", "ZoomInfo Company Profile URL"]
VENDOR_CONTACTS = ["Person Street", "Person City", "Person State", "Person Zip Code", "First Name", "Last Name", "Company Name", "Job Title", "Direct Phone Number", "Email Address"]
